"""The pipeline against a plain version of its stages on small tables."""

import hashlib
import re
import struct
import tempfile

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tessera.llm import quality_rules
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_small_operators import plain_quality


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "sentencepiece"]


def test_pipeline_equals_plain_version(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    src.filter("length(text) < 1500").write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))

    rows = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rules = quality_rules.POLICIES["v1"]
    assert rules == ("few_words", "repeated_words", "many_symbols", "repeated_lines")

    def good(t):
        n, _, symbols, dup, rep = plain_quality(t)
        lines = sum(bool(x.strip(" \t\n\r\f\v")) for x in t.split("\n"))
        return not (n < 50 or 100 * rep > 50 * n or 4 * symbols > n or 10 * dup > 3 * lines)

    rows = {d: r for d, r in rows.items() if good(r.text)}
    last = {}
    for d in sorted(rows):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in rows[d].text)] = d
    rows = {d: rows[d] for d in last.values()}
    classes = near_brute([(d, r.text) for d, r in rows.items()])
    rows = {d: r for d, r in rows.items() if classes[d] == d}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size = {d: len(word.findall(r.text)) for d, r in rows.items()}
    sources = sorted({r.source for r in rows.values()})
    own = {s: [d for d in rows if rows[d].source == s] for s in sources}
    of = {s: sum(size[d] for d in own[s]) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    fixed = {}
    while True:
        rest, w = sum(of.values()) - sum(fixed.values()), sum(weight[s] for s in sources if s not in fixed)
        goal = fixed | {s: rest * weight[s] / w for s in sources if s not in fixed}
        above = [s for s in goal if s not in fixed and goal[s] > 3 * of[s]]
        if not above:
            break
        fixed |= {s: float(3 * of[s]) for s in above}
    want = []
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for s in sources:
        epochs, rest = divmod(int(goal[s] + 1e-9), of[s])
        before = 0
        for d in sorted(own[s], key=lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()):
            part = max(0, min(size[d], rest - before))
            before += size[d]
            texts = [rows[d].text] * epochs
            if part:
                texts.append(rows[d].text if part == size[d] else rows[d].text[: [m.end() for m in word.finditer(rows[d].text)][part - 1]])
            for t in texts:
                ids = lib.encode(t, add_bos=True, add_eos=True)
                want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
