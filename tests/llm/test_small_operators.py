"""Edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, exact_dedup, language_id, mixing, quality_rules, sentence_spans, url_filter
from tessera.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, kept string, size string, words string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), "c", "c", "c") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    assert assert_same(spark, QUERIES[name], ORACLES[name], SF) > 0


# URL filter


def test_url_rules(spark):
    urls = [
        "https://a.com/x?q", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://x.example.com/en/", "http://b.net/fr/1#t", "http://b.net/de/1", "http://com/",
        "http://a.com", "telecom/", None, "", "x://y://z.com/", "http://notexample.com/en/", "http://h.net?/es/",
    ]
    df = spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, score double")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    rules = ["com/", "example.com/en/", "www.example.com/en/", "example.com/en/", "net/fr/", None, "com/", None, None, None, None, None, "com/", None]
    assert [got[i].rule for i in range(len(urls))] == rules
    assert [got[i].verdict for i in (0, 1, 2, 3, 4)] == ["allow", "block", "allow", "block", "block"]
    assert (got[1].host, got[1].path) == ("example.com", "/en/1") and (got[9].host, got[9].path) == ("", "") and got[11].host == "y:"
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.filter_urls(df.filter("false")).count() == 0


class PlainModel:
    """Both Markov models by counting characters behind contexts."""

    def __init__(self, urls):
        self.n, self.total = Counter(), Counter()
        for s, label in urls:
            for ctx, c in self.steps(s):
                self.n[label, ctx, c] += 1
                self.total[label, ctx] += 1

    @staticmethod
    def steps(s):
        t = "\x02" * url_filter.ORDER + s
        return [(t[i - k : i], t[i]) for i in range(url_filter.ORDER, len(t)) for k in range(url_filter.ORDER + 1)]

    def p(self, label, past, c):
        p = 1 / url_filter.ALPHABET
        for k in range(url_filter.ORDER + 1):
            ctx = past[len(past) - k :]
            p = (self.n[label, ctx, c] + url_filter.STRENGTH * p) / (self.total[label, ctx] + url_filter.STRENGTH)
        return p

    def score(self, s):
        t, o = "\x02" * url_filter.ORDER + s, url_filter.ORDER
        total = sum(round((math.log(self.p("allow", t[i - o : i], t[i])) - math.log(self.p("block", t[i - o : i], t[i]))) * 2**32) for i in range(o, len(t)))
        return total / 2**32 / len(s) if s else 0.0


def test_url_query_equals_a_plain_version(spark):
    rng = random.Random(1)
    good = [f"site{rng.randint(0, 99)}.com/article/{rng.randint(0, 999)}" for _ in range(200)]
    bad = [f"casino-{rng.randint(0, 99)}.net/fr/win/{rng.randint(0, 999)}" for _ in range(200)] + ["casino-1.net/fr/win/5"] * 20
    open_ = [f"site{i}.org/article/{i}" for i in range(50)] + [f"casino-{i}.org/fr/win/{i}" for i in range(50)] + ["grüße.org/🙂", "", "x" * 30_000]
    urls = ["http://" + u for u in good + bad + open_] + [None, "", "none"]
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, score double").repartition(3)
    fold = spark.createDataFrame([(u.partition("/")[0], u[len(u.partition("/")[0]) :]) for u in good + bad], "host string, path string")
    fold = {r.host + r.path: r.f for r in fold.select("*", F.pmod(F.xxhash64("host", "path"), F.lit(5)).alias("f")).collect()}
    labelled = [(u, "allow") for u in good] + [(u, "block") for u in bad]
    model = PlainModel([(u, x) for u, x in labelled if fold[u]])
    held = [(model.score(u), x) for u, x in labelled if not fold[u]]
    grid = [i * 2 * url_filter.RANGE / url_filter.BINS - url_filter.RANGE for i in range(url_filter.BINS + 1)]
    share = lambda e: sum(s >= e for s, x in held if x == "allow") / sum(x == "allow" for _, x in held) + sum(s < e for s, x in held if x == "block") / sum(x == "block" for _, x in held)
    best = max(map(share, grid))
    limit = min((abs(e), e) for e in grid if share(e) >= best - 1e-12)[1]
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        s = (u or "").partition("://")[2]
        want = model.score(s)
        assert got[i].score == pytest.approx(want, abs=1e-8) and got[i].threshold == pytest.approx(limit)
        assert got[i].verdict == (got[i].rule and dict(com="allow", net="block")[got[i].rule[:3]] or ("allow" if want >= limit else "block"))
    assert sum(got[420 + i].verdict == "allow" for i in range(50)) >= 48 and sum(got[470 + i].verdict == "block" for i in range(50)) >= 48


def test_every_context_has_a_distribution_that_sums_to_one(spark):
    rows = [("abcab/é", "allow", 2), ("abd", "allow", 1), ("xyxy", "block", 1), ("", "block", 1)]
    counts = url_filter.count(spark.createDataFrame(rows, "s string, label string, n int"))
    signs = "abcdxy/é\x02"
    pasts = ["\x02" * 5, "\x02\x02abc", "xyxyx", "zzzzz", "qqqab"]
    got = url_filter.ratios(spark.createDataFrame([(p + c,) for p in pasts for c in signs + "q"], "g string"), counts).collect()
    plain = PlainModel([(s, x) for s, x, n in rows for _ in range(n)])
    for kind in ("allow", "block"):
        for past in pasts:
            own = {r.g[-1]: math.exp(r[kind]) for r in got if r.g[:-1] == past}
            assert sum(own[c] for c in signs) + own["q"] * (url_filter.ALPHABET - len(signs)) == pytest.approx(1)
            assert own == pytest.approx({c: plain.p(kind, past, c) for c in own})


# Chat format


def test_chat_edges(spark):
    nasty = ["", "\\", "\\\\<s>", "<\\s>", "[INST", "x<", "</s>[INST][/INST]<s>", "\\[/INST]", "a\nb", None]
    rows = [(1, i, role, t, "x") for i, t in enumerate(nasty) for role in ("assistant",)] + [(2, 0, None, "t", "x"), (2, 0, "[INST]", "u", "x"), (None, None, "user", "n", "x"), (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.format_chats(df)
    raw = F.col("formatted").cast("binary")
    back = got.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(raw, F.col("loss_spans")).alias("loss"))
    by = {r.conv_id: r for r in back.collect()}
    assert [x.text for x in by[1].t] == [t or "" for t in nasty] and by[1].loss == "".join(t or "" for t in nasty)
    assert by[1].formatted.count("<s>") == 1 and by[1].formatted.startswith("<s>assistant[INST]")
    assert [(x.role, x.text) for x in by[2].t] == [("", "t"), ("[INST]", "u")]
    assert len(by[3].t) == 2 and by[None].loss == ""
    digest = {r.conv_id: r for r in chat_format.chat_digest(df).collect()}
    assert digest[1].n_turns == len(nasty)
    assert digest[1].turns_sha256 == hashlib.sha256("".join(f"assistant\n{t or ''}\n" for t in nasty).encode()).hexdigest()
    assert chat_format.chat_digest(df.filter("false")).count() == 0


def test_long_conversations_take_time_in_proportion(spark):
    took = []
    for n in (20_000, 80_000):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<s> "), "id").alias("text"))
        start = time.perf_counter()
        got = chat_format.chat_digest(turns).collect()[0]
        took.append(time.perf_counter() - start)
        texts = [f"é<s> {i}" for i in range(n) if i % 3]
        assert got.n_turns == n and got.loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert took[1] < 10 * took[0] + 2, took
    long = spark.createDataFrame([(1, 0, "assistant", "ab\\[INST]é" * 200_000)], "conv_id long, turn long, role string, text string")
    assert chat_format.chat_digest(long).collect()[0].loss_sha256 == hashlib.sha256(("ab\\[INST]é" * 200_000).encode()).hexdigest()


def test_chat_runs_no_python(spark):
    plan = QUERIES["op2_chat_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Quality rules


def plain_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_edges(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\n\nx\nx \nx", "# a|b <c> & * $ % é 世界", "a a a a a a", "w " * 20000 + "end", "\x0b\x0c\r\u00a0z", "one two three\none two three"]
    texts += [" ".join(random.Random(i).choice("abcdef") for _ in range(60)) for i in range(10)]
    df = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (4, texts[4])])
    got = {r.doc_id: r for r in quality_rules.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if i != 8:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(t), t
    assert (got[8].n_words, got[8].n_repeat_words) == (20001, 20000)
    assert got[0].fail_bits & quality_rules.bit("few_words")
    assert quality_rules.ledger(df.filter("false")).count() == 0
    kept = quality_rules.passing(df, "v1")
    assert kept.columns == df.columns and kept.count() == sum(not r.fail_bits & quality_rules.mask("v1") for r in quality_rules.ledger(df).collect())


def test_ablation(spark):
    bits = [0, 1, 1, 3, 2, 16, 4, 12]
    book = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, fail_bits long")
    got = {r.rule: r for r in quality_rules.ablation(book, "v1").collect()}
    m = quality_rules.mask("v1")
    kept = sum(not b & m for b in bits)
    for rule in quality_rules.POLICIES["v1"]:
        x = quality_rules.bit(rule)
        assert (got[rule].failed, got[rule].failed_alone, got[rule].kept) == (sum(bool(b & x) for b in bits), sum(b & m == x for b in bits), kept)
        assert got[rule].kept_without == sum(not b & m & ~x for b in bits)


# Exact dedup


@pytest.mark.parametrize("key_bits,capacity", [(64, 1 << 22), (2, 40), (64, 30)])
def test_exact_edges(spark, key_bits, capacity):
    texts = ["abc", "ABC", "aBc", None, "", "é", "É", "x" * 100_000, "X" * 100_000, "q"] + [f"t{i % 7}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q"), (3, "z"), (49, "t4"), (49, "t4")]
    df = docs(spark, rows).repartition(3)
    got = exact_dedup.exact_dedup(df, capacity, key_bits).collect()
    assert len(got) == len(rows)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    for r in got:
        g = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(g) and r.keep_id == max(x for x in g if x is not None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(df, capacity)
    assert kept.columns == df.columns
    assert sorted((low(r.text) for r in kept.collect())) == sorted(groups)
    assert exact_dedup.exact_dedup(df.filter("false")).count() == 0


def test_directory_splits_overfull_buckets():
    cells = {0: 10, 1: 10, 2: 1, 7: 5}
    pointers = exact_dedup.directory(cells, 3, 10)
    assert pointers[0] != pointers[1] and len(pointers) == 8 and (np.diff(pointers) >= 0).all()
    for b in set(pointers.tolist()):
        inside = [p for p in range(8) if pointers[p] == b]
        assert sum(cells.get(p, 0) for p in inside) <= 10 or len(inside) == 1
    assert exact_dedup.directory({}, 2, 5).tolist() == [0, 0, 0, 0]


# Mixing


def test_mixing_edges(spark):
    rows = [(1, "a b c d", None, "s"), (2, None, None, "s"), (3, "a", None, None), (4, "b c", None, "t"), (4, "b c", None, "t"), (None, "w x", None, "t"), (5, "", None, "z")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target + 1e-9) and own[0].source_size == sum(r.size for r in own)
        assert all(r.taken <= 3 * r.size for r in own) and own[0].target <= 3 * own[0].source_size
    assert mixing.mix(df.filter("false")).count() == 0


def test_targets_equal_resharing_step_by_step(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000]) for i in range(8)}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df, (1, 2, 3), 3).collect()}
        weight = {s: (i % 3) + 1 for i, s in enumerate(sorted(sizes))}
        want, fixed, total = {}, {}, sum(sizes.values())
        while True:
            rest, w = total - sum(fixed.values()), sum(weight[s] for s in sizes if s not in fixed)
            want = fixed | {s: rest * weight[s] / w for s in sizes if s not in fixed}
            above = [s for s in want if s not in fixed and want[s] > 3 * sizes[s]]
            if not above:
                break
            fixed |= {s: 3 * sizes[s] for s in above}
        assert got == pytest.approx(want)


def test_mixed_rows_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 9)), "en", "ab"[i % 7 == 0]) for i in range(60)]
    df = docs(spark, rows).withColumn("n_chars", F.length("text").cast("bigint"))
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {d: t for d, t in taken.items() if t}


def test_mixed_goes_by_row_where_ids_repeat_and_reruns_agree(spark):
    long = "word " * 40_000
    rows = [(7, "a b c", None, "s"), (7, "d e f g h i", None, "s"), (7, None, None, "s"), (None, "j k", None, "t"), (None, "l", None, None), (1, long, None, "t"), (7, "a b c", None, "s"), (8, "", None, "u")]
    df = docs(spark, rows)
    runs = [sorted(map(tuple, mixing.mixed(df.repartition(n)).collect()), key=repr) for n in (1, 4)]
    assert runs[0] == runs[1]
    plan = mixing.mix(df).collect()
    for s in ("s", "t", None):
        assert sum(len(r[1].split()) for r in runs[0] if r[3] == s) == sum(r.taken for r in plan if r.source == s)
    assert mixing.mixed(df.filter("false")).count() == 0
    clash = df.select("*", *[F.lit("c").alias(c) for c in ("row", "key", "range", "rank", "taken", "target")])
    assert mixing.mixed(clash).columns == clash.columns


# Language identification


def test_language_accuracy_on_held_out_rows(spark):
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !!", None), (5, "", "de"), (6, "zzz", None), (None, "the dog", "fr"), (7, "the cat " * 20000, None), (6, "zzz", None)]
    got = language_id.identify(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    assert by[7].lang_pred in ("en", "de") and by[None].held_out is False
    assert "fr" not in {r.lang_pred for r in got}
    none = language_id.identify(docs(spark, [(1, "text", None)])).collect()
    assert none[0].lang_pred == "und"
    assert language_id.identify(docs(spark, rows).filter("false")).count() == 0


def test_trigram_bundle_equals_binding_position_by_position():
    p = language_id.Profiles()
    ids, counts = p.trigrams("Aж, aж!")
    c = [0, ord("a"), ord("ж"), 0, ord("a"), ord("ж"), 0]
    want = sum(np.roll(p.letter(a), 2).astype(int) * np.roll(p.letter(b), 1) * p.letter(d) for a, b, d in zip(c, c[1:], c[2:]))
    assert (p.bundle(ids, counts) == want).all()
    letters = [p.letter(ord(x)) for x in "aжλ漢語я"]
    assert all(abs(int(x.astype(int) @ y)) < 150 for i, x in enumerate(letters) for y in letters[:i])


def test_language_predictions_equal_a_plain_version(spark, monkeypatch):
    rng = random.Random(41)
    scripts = {"el": "αβγδεζηθ", "ru": "абвгдежз", "zh": "漢語文字学習", "en": "abcdefgh", "xx": "abcdefgh"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(scripts))
        rows.append((i, " ".join("".join(rng.choice(scripts[lang][: 4 if lang == "en" else 8]) for _ in range(rng.randint(1, 7))) for _ in range(30)), lang if i % 9 else None))
    rows += [(200, None, "el"), (201, "12 !", "el"), (None, "абв", "yy")]
    p, sums = language_id.Profiles(), {}

    def bundle(text):
        c = [0]
        for x in (text or "").lower():
            k = ord(x) if x.isalpha() else 0
            if k or c[-1]:
                c.append(k)
        c += [0] if c[-1] else []
        if len(c) < 3:
            return None
        return sum(np.roll(p.letter(a), 2).astype(int) * np.roll(p.letter(b), 1) * p.letter(d) for a, b, d in zip(c, c[1:], c[2:]))

    for d, t, lang in rows:
        if d is not None and lang and zlib.crc32(str(d).encode()) % 5 and (v := bundle(t)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    monkeypatch.setattr(language_id, "REMEMBERED", 5000)
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows).repartition(3)).collect()}
    for d, t, _ in rows:
        v = bundle(t)
        cos = {x: float(v @ s) / math.sqrt(float(v @ v) * float(s @ s)) for x, s in sums.items()} if v is not None else {}
        assert got[d].lang_pred == (max(sorted(cos), key=cos.get) if cos else "und")
        assert got[d].score == pytest.approx(max(0.0, *cos.values()) if cos else 0.0, abs=1e-4)
        assert got[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)


# Sentence spans


def plain_spans(rows):
    """(doc_id, text) to the text that stays and the units removed, by comparing all runs as text."""
    cut = {}
    for d, t in rows:
        u = sentence_spans._units(t or "")
        s = [x.strip(sentence_spans.BLANK) for x in u]
        own = []
        for i in range(len(s)):
            for j in range(i + sentence_spans.RUN, len(s) + 1):
                if sum(map(len, s[i:j])) >= sentence_spans.LEAST:
                    own.append((i, j, tuple(s[i:j])))
                    break
        cut[d, t] = u, own
    order = sorted(cut, key=lambda k: (k[0] if k[0] is not None else -(2**63), hashlib.sha256((k[1] or "").encode()).hexdigest()))
    first = {}
    for k in order:
        for i, _, run in cut[k][1]:
            first.setdefault(run, (k, i))
    out = {}
    for k in order:
        gone = {x for i, j, run in cut[k][1] if first[run] != (k, i) for x in range(i, j)}
        out[k] = "".join(x for i, x in enumerate(cut[k][0]) if i not in gone) if gone else k[1], len(gone)
    return out


def prose(rng, words):
    """Invented prose with sentences of up to 25 words and some commas."""
    out, left = [], 0
    for _ in range(words):
        left = left or rng.randint(4, 25)
        left -= 1
        out.append("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) + ("." if not left else "," if rng.random() < 0.08 else ""))
    return " ".join(out)


def test_sentence_spans_equal_comparing_all_runs(spark):
    rng = random.Random(21)
    passages = [prose(rng, rng.randint(30, 90)) for _ in range(6)]
    rows = [(i, " ".join(x for _ in range(rng.randint(1, 3)) for x in (prose(rng, rng.randint(0, 40)), rng.choice(passages)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "..."), (None, rows[0][1]), (3, rows[3][1]), (4, rows[8][1]), (53, "a. " * 3_000), (54, rows[2][1] * 20), (None, rows[1][1] + " x.")]
    df = docs(spark, rows).repartition(3)
    got = sentence_spans.remove_repeats(df)
    assert got.columns == [*df.columns, "n_sentences", "n_removed"]
    back, plain = got.collect(), plain_spans(rows)
    assert len(back) == len(rows)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in back), key=repr) == sorted(((k[0], *plain[k]) for k in rows), key=repr)
    assert sentence_spans.remove_repeats(df.filter("false")).count() == 0
    clash = df.select("*", *[F.lit("c").alias(c) for c in ("_", "at", "row", "n", "sha", "n_removed")])
    again = sentence_spans.remove_repeats(clash)
    assert again.columns == [*clash.columns[:-1], "n_sentences", "n_removed"]
    assert sorted(map(str, again.select("doc_id", "text", "n_removed").collect())) == sorted(map(str, got.select("doc_id", "text", "n_removed").collect()))


def test_passages_inside_sentences_are_caught_and_clean_documents_left_alone(spark):
    rng = random.Random(22)
    rows, planted = [], set()
    for i in range(150):
        passage = prose(rng, rng.randint(51, 60))
        for k in (0, 1):
            rows.append((2 * i + k, f"{prose(rng, 120).rstrip('.,')} {passage.rstrip('.,')} {prose(rng, 120)}"))
        planted.add(2 * i + 1)
    tiny = ["See!", "OK.", "Yes.", "No, thanks.", "Dear all,", "Hi.", "All rights reserved.", "Read more..."]
    clean = {1000 + i for i in range(200)}
    rows += [(i, " ".join(rng.choice(tiny) if rng.random() < 0.4 else prose(rng, 9) + "." for _ in range(60))) for i in clean]
    gone = {r.doc_id for r in sentence_spans.remove_repeats(docs(spark, rows)).filter("n_removed > 0").collect()}
    caught, left = len(planted & gone) / len(planted), 1 - len(clean & gone) / len(clean)
    print(f"caught {caught:.3f}, clean {left:.3f}")
    assert caught >= 0.95 and left >= 0.95 and not gone - planted - clean


def test_sentence_tasks_that_flush_early_give_the_same(spark, monkeypatch):
    rng = random.Random(23)
    p = [prose(rng, 60) for _ in range(3)]
    rows = [(i, f"{prose(rng, 20)} {rng.choice(p)} {prose(rng, 20)}") for i in range(30)]
    monkeypatch.setattr(sentence_spans, "HELD", 5)
    got = sentence_spans.remove_repeats(docs(spark, rows)).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {(k[0], *v) for k, v in plain_spans(rows).items()}
