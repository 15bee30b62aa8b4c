import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, id string, key string"


def shingles(text):
    w = nd._words(text or "")
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def brute(rows):
    """class of each id by comparing all pairs."""
    ids = sorted({d if d is not None else nd.NO_ID for d, _ in rows})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seqs = [(d if d is not None else nd.NO_ID, nd._words(t or ""), shingles(t)) for d, t in rows]
    for i, (d, w, a) in enumerate(seqs):
        for e, v, b in seqs[:i]:
            most = (Counter(a) & Counter(b)).total()  # no alignment is longer
            n = lcs(a, b) if a and b and most >= 0.8 * (len(a) + len(b) - most) else 0
            if w == v or (a and b and n >= 0.8 * (len(a) + len(b) - n)):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(14):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 140))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choice(vocab) for _ in range(60))) for i in range(15)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "one three"), (None, rows[0][1]), (906, rows[4][1]), (906, rows[4][1])]
    rows += [(907, "a b c d e " * 40), (908, "a b c d e " * 41)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    got = nd.near_dedup(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    mine = {r.doc_id if r.doc_id is not None else nd.NO_ID: r.class_id if r.class_id is not None else nd.NO_ID for r in got}
    assert mine == want
    sizes = Counter(want[d if d is not None else nd.NO_ID] for d, _ in rows)
    assert all(r.class_size == sizes[want[r.doc_id if r.doc_id is not None else nd.NO_ID]] for r in got)
    assert nd.keep_one(df).count() == len(set(want.values()))
    assert nd.keep_one(df).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nd.near_dedup(df).count() == 0


def test_alignment_is_exact_above_the_threshold():
    rng = random.Random(3)
    for _ in range(60):
        a = list(range(rng.randint(5, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 3)] = [rng.randint(100, 10**6) for _ in range(rng.randint(0, 3))]
            if not b:
                b = [1]
        if rng.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        b = list(dict.fromkeys(b))
        n = lcs(a, b)
        exact = n / (len(a) + len(b) - n)
        got = nd.similarity(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert got == pytest.approx(exact) if exact >= 0.8 else got <= exact + 1e-9


def test_sketches_meet_at_the_threshold():
    rng = np.random.default_rng(5)
    met = []
    for _ in range(300):
        a = rng.integers(0, 2**63, 90, dtype=np.uint64)
        b = a.copy()
        b[rng.choice(90, 10, replace=False)] = rng.integers(0, 2**63, 10, dtype=np.uint64)  # 80 / 100
        met.append((nd.sketch(a) == nd.sketch(b)).sum())
    assert min(met) >= 1
    assert 0.8**5 * nd.SKETCHES * 0.8 < np.mean(met) < 0.8**5 * nd.SKETCHES * 1.2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (-5, 200)], "a long, b long")
    got = {r.id: r.label for r in nd.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == 100 and got[200] == -5


def test_template_crowd_loses_no_pair(spark):
    """Pairs whose ends are neither first nor last of the buckets of their crowd."""
    rng = random.Random(11)
    fresh = iter(range(10**7))
    template = [f"t{i}" for i in range(200)]

    def edited(places):
        words = list(template)
        for p in places:
            words[p] = f"u{next(fresh)}"
        return words

    spots = lambda: [rng.randrange(i * 50 + 5, i * 50 + 45) for i in range(4)]
    rows, pairs = [edited(spots()) for _ in range(200)], []
    for _ in range(20):  # 176 of 216 shingles are common, 0.81, and the crowd has each of them
        places = spots()
        pairs.append((len(rows), len(rows) + 1))
        rows += [edited(places), edited(places)]
    names = list(range(len(rows)))
    rng.shuffle(names)
    named = [(names[i], " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in named], SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in nd.near_dedup(df).collect()}
    assert [got[names[a]] for a, _ in pairs] == [got[names[b]] for _, b in pairs]
    seqs = [(d, nd.shingle_hashes(nd._words(t))) for d, t in named]
    near = [(d, e) for i, (d, a) in enumerate(seqs) for e, b in seqs[:i] if nd.similarity(a, b) >= 0.8 - 1e-12]
    assert len(near) >= len(pairs) and all(got[d] == got[e] for d, e in near)


def test_short_texts_link_without_a_shared_sketch(spark):
    rng = random.Random(12)
    rows = []
    for base in range(40):
        words = [f"b{base}w{i}" for i in range(8 + base % 3)]
        rows += [" ".join(words), " ".join([*words, "end"] if base % 2 else ["start", *words])]
    for base in range(40):  # 8 of 10 shingles
        words = [f"c{base}w{i}" for i in range(12)]
        rows += [" ".join(["one", *words]), " ".join([*words, "two"])]
    rows += ["lone text of six short words", "another lone text of seven short words"]
    names = list(range(len(rows)))
    rng.shuffle(names)
    named = [(names[i], t) for i, t in enumerate(rows)]
    got = {r.doc_id: r.class_id for r in nd.near_dedup(spark.createDataFrame([(d, t, "x", "y") for d, t in named], SCHEMA)).collect()}
    assert got == brute(named)
    assert sum(got[names[i]] == got[names[i + 1]] for i in range(0, 160, 2)) == 80


def test_alignment_of_repeated_shingles_is_the_plain_common_subsequence():
    rng = random.Random(4)
    for _ in range(80):
        a = [rng.randint(0, 12) for _ in range(rng.randint(5, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 2)] = [rng.randint(0, 12) for _ in range(rng.randint(0, 2))]
        if not b:
            continue
        n = lcs(a, b)
        exact = n / (len(a) + len(b) - n)
        got = nd.similarity(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert got == pytest.approx(exact) if exact >= 0.8 else got < 0.8


def test_one_more_early_occurrence_of_a_phrase_keeps_the_pair(spark):
    rng = random.Random(5)
    phrase = "the same seven words stand here again"
    parts = [" ".join(f"x{rng.randint(0, 10**6)}" for _ in range(20)) for _ in range(12)]
    text = f" {phrase} ".join(parts)
    rows = [(1, text), (2, f"{phrase} {text}"), (3, "short other text " * 3)]
    got = {r.doc_id: r.class_id for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[2] == 1


def test_rows_of_one_id_go_by_their_own_texts(spark):
    rng = random.Random(6)
    make = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d = make(), make(), make(), make()
    rows = [(1, a), (5, a + " end"), (5, b), (None, c), (None, d), (7, c + " end"), (5, b)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = nd.keep_one(df)
    assert sorted(kept.collect(), key=repr) == sorted(df.filter(~df.text.endswith(" end")).dropDuplicates().collect(), key=repr)
    got = nd.near_dedup(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 5
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (5, 1), (5, 5), (None, None), (7, None)}


def test_long_texts_and_nulls_in_every_column(spark):
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59_000])), (3, "z " * 30_000), (4, "z " * 30_100), (None, None)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in nd.near_dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, None: None}
