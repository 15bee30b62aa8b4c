"""URL filtering by rules and a character language-model ratio.

Rules come first: the longest rule that fits a URL decides. URLs without a rule go to two smoothed
variable-order Markov models over the characters of host and path, one of the URLs that rules
accept and one of those they reject. The score is the difference of the two log-likelihoods over the
length; its threshold is calibrated on a fifth of the decided URLs that the models never saw.

A model interpolates orders 0 to ORDER: P_k(c | ctx) = (n(ctx, c) + STRENGTH * P_{k-1}(c)) / (n(ctx) + STRENGTH),
where n(ctx) is the sum of n(ctx, c) over all c and P_{-1} is uniform over all code points. So every context has a
distribution that sums to 1, and a context never seen falls back to the shorter one. Before a URL stand ORDER start signs.

All work is joins and aggregates over tables that grow with the pages. A position's probability depends on its gram alone, the
ORDER characters before it and its own. So grams are counted as they are, without hashing, from distinct URLs; each distinct
gram is looked up once in the counts of each order; and distinct URLs add up the ratios of their grams, as whole numbers
of 2**-32, so that no order of rows changes a score. The driver sees the number of training characters and at most 2 * BINS
counts of the threshold's histogram.

A null URL, or one without ``://``, has empty host and path and scores 0, which is judged like any other score. Empty
URLs count as null. With no decided URLs of one kind the threshold is 0; with none at all, all scores are 0 too, which
allows. URLs of any length are taken whole. Repeated pages count as often as they stand there and get a row
each; columns besides page_id and url are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Production rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
STRENGTH = 4.0
#: Code points, all of which the uniform distribution below order 0 covers.
ALPHABET = 0x110000
#: Scores are cut to +-RANGE and counted in BINS bins to find the threshold.
RANGE, BINS = 4.0, 4096
_START = "\u0002"
_UNIT = 1 << 32


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a URL column; empty where there is no ``://``."""
    c = F.col(url)
    rest = F.when(c.contains("://"), F.substr(c, F.locate("://", c) + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decide(rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits ``host`` and ``path``; null if none does."""
    host, path = F.col("host"), F.col("path")
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and g, the gram of every position of ``s``: the ORDER characters before it, start signs included, and its own."""
    # A column of its own, as a lambda works an expression out anew for each element.
    rows = urls.filter("s <> ''").select(*keep, F.split(F.concat(F.lit(_START * ORDER), F.col("s")), "").alias("signs"))
    places = F.sequence(F.lit(0), F.size("signs") - ORDER - 1)
    return rows.select(*keep, F.explode(F.transform(places, lambda i: F.concat(*[F.get("signs", i + k) for k in range(ORDER + 1)]))).alias("g"))


def count(urls: DataFrame) -> DataFrame:
    """ctx, c, allow, block: how often a character follows a context of 0 to ORDER characters in URLs (s, label, n) of either kind."""
    kinds = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(k) for k in ("allow", "block")]
    whole = grams(urls, "label", "n").groupBy("g").agg(*kinds)
    own = F.array(*[F.struct(F.substr("g", F.lit(ORDER + 1 - k), F.lit(k)).alias("ctx"), F.right("g", F.lit(1)).alias("c")) for k in range(ORDER + 1)])
    rows = whole.select("allow", "block", F.explode(own).alias("x"))
    return rows.groupBy("x.ctx", "x.c").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def ratios(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """g, allow and block (log-probability of its last character under each model) of distinct grams ``g``."""
    totals = counts.filter("ctx <> ''").groupBy("ctx").agg(F.sum("allow").alias("t_allow"), F.sum("block").alias("t_block"))
    # The empty context is one row that every gram needs: two numbers instead of a join.
    one = counts.filter("ctx = ''").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("allow", "block")]).first()
    parts = [
        F.struct(F.lit(k).alias("k"), F.substr("g", F.lit(ORDER + 1 - k), F.lit(k)).alias("ctx"), F.right("g", F.lit(1)).alias("c")) for k in range(ORDER + 1)
    ]
    rows = wanted.select("g", F.explode(F.array(*parts)).alias("x")).select("g", "x.k", "x.ctx", "x.c")
    rows = rows.join(counts, ["ctx", "c"], "left")
    rows = rows.filter("ctx = ''").withColumns({"t_allow": F.lit(one.allow), "t_block": F.lit(one.block)}).unionByName(rows.filter("ctx <> ''").join(totals, "ctx", "left"))
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    wide = rows.groupBy("g").agg(*[at(c, k) for c in ("allow", "block", "t_allow", "t_block") for k in range(ORDER + 1)])
    out = []
    for kind in ("allow", "block"):
        p = F.lit(1 / ALPHABET)
        for k in range(ORDER + 1):
            p = (F.col(f"{kind}{k}") + STRENGTH * p) / (F.col(f"t_{kind}{k}") + STRENGTH)
        out.append(F.log(p).alias(kind))
    return wide.select("g", *out)


def scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """u and score of distinct URLs (u, s): the accepted less the rejected log-likelihood over the length; 0 if empty."""
    places = grams(urls, "u").groupBy("u", "g").agg(F.count(F.lit(1)).alias("n"))
    places = written(places, "url-grams")
    known = ratios(places.select("g").distinct(), counts).select("g", F.round((F.col("allow") - F.col("block")) * _UNIT).cast("bigint").alias("ratio"))
    # Written, as adaptive execution splits a skewed join only where both sides come straight from a shuffle.
    total = places.join(written(known, "gram-ratios"), "g").groupBy("u").agg(F.sum(F.col("n") * F.col("ratio")).alias("total"))
    score = F.coalesce(F.col("total") / _UNIT / F.length("s"), F.lit(0.0))
    return urls.select("u", "s").join(total, "u", "left").select("u", score.alias("score"))


def threshold(held: DataFrame) -> float:
    """The score that best separates held-out accepted from rejected URLs (label, score, n): highest balanced accuracy, nearest to 0 if several."""
    cut = F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE - 1e-9), F.col("score")))
    rows = held.groupBy(F.floor((cut + RANGE) / (2 * RANGE) * BINS).cast("int").alias("bin"), "label").agg(F.sum("n").alias("n")).collect()
    counts = {k: np.zeros(BINS) for k in ("allow", "block")}
    for r in rows:
        counts[r.label][r.bin] += r.n
    if not all(c.sum() for c in counts.values()):
        return 0.0
    edges = np.arange(BINS + 1) * (2 * RANGE / BINS) - RANGE
    kept = 1 - np.concatenate([[0], np.cumsum(counts["allow"])]) / counts["allow"].sum()
    blocked = np.concatenate([[0], np.cumsum(counts["block"])]) / counts["block"].sum()
    best = np.flatnonzero(kept + blocked >= (kept + blocked).max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every page."""
    host, path = host_and_path()
    df = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path"))
    rule, label = decide(rules)
    urls = df.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    urls = urls.select("*", rule.alias("rule"), label.alias("label"), F.concat("host", "path").alias("s"), F.monotonically_increasing_id().alias("u"))
    urls = written(urls.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(5))), "urls")
    counts = written(count(urls.filter("label IS NOT NULL AND fold <> 0")), "gram-counts")
    judged = written(urls.drop("s").join(scored(urls.select("u", "s"), counts), "u"), "judged-urls")
    limit = threshold(judged.filter("label IS NOT NULL AND fold = 0"))
    verdict = F.coalesce("label", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    judged = judged.select("host", "path", "rule", verdict.alias("verdict"), "score", F.lit(limit).alias("threshold"))
    return df.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score", "threshold")
