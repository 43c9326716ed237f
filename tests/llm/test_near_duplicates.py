import random

import corpus_pipeline
from fraglens.llm import near_duplicates as N


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components(rows):
    up = {d: d for d in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if alike(rows[a], rows[b]):
                    up[a] = up[b] = min(up[a], up[b])
        if all(up[up[d]] == up[d] for d in up) and all(up[a] == up[b] for a in rows for b in rows if alike(rows[a], rows[b])):
            return up


def corpus():
    rnd = random.Random(4)
    rows = {}
    for d in range(12):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(80, 200))]
        rows[d] = " ".join(w)
        for k in range(1, 5):
            v = list(w)
            for at in rnd.sample(range(len(v)), rnd.randint(1, max(2, len(v) // 40))):
                v[at] = "Edit"
            rows[100 * k + d] = "\n".join(v)
    rows |= {900: rows[3], 901: None, 902: "", 903: "two words", 904: "Two  words", 905: "words two"}
    return rows


def test_against_brute_jaccard(spark):
    rows = corpus()
    got = N.near_components(spark.createDataFrame([*rows.items(), (900, rows[900])], "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in got} == components(rows)


def test_stage_keeps_one_of_pairs_of_eight_tenths(spark):
    """Two edits of 100 words leave 86 of 106 shingles in common, 0.81: more bits apart than SimHash links take."""
    rnd = random.Random(1)
    rows = []
    for d in range(20):
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(100)]
        rows += [(d, " ".join(w)), (100 + d, " ".join([*w[:30], "x", *w[31:70], "y", *w[71:]])), (200 + d, " ".join([*w[:20], "x", *w[21:50], "y", *w[51:80], "z", *w[81:]]))]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == {*range(20), *range(200, 220)}


def test_empty(spark):
    assert N.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_first_of_groups_on_odd_rows(spark):
    """Repeated rows, one id with two texts, rows without an id, long texts and clashing columns."""
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "quite another text of seven words", "y"), (None, "a b c d e f g", "z"), (None, "no id has this one", "z"), (None, None, "n"), (5, "", "n"), (6, long, "l"), (7, long + " end", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string").selectExpr("*", "1 as sid", "2 as content", "3 as fp")
    got = N.first_of_groups(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, rows[0][1]), (1, rows[2][1]), (None, rows[4][1]), (5, ""), (6, long)], key=str)


def test_half_set_bits_and_sums_over_slices():
    import numpy as np

    rnd = np.random.RandomState(0)
    value = rnd.randint(0, 2**63, 1000).astype(np.uint64)
    bounds = np.array([0, 0, 1, 400, 402, 1000])
    want = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        want.append(sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in value[lo:hi]) > hi - lo))
    for step in (1 << 16, 7):
        assert [int(x) % 2**64 for x in N.set_fingerprints(value, bounds, step)] == want
