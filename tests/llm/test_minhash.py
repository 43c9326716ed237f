import random

import numpy as np
import pytest

from fraglens.llm import minhash as M


def shingles(text):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def brute(rows):
    """{row number: (n_shingles, component)} by comparing all pairs of sets."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)] if sets[i] else [rows[i][0]]
        out.append((rows[i][0], len(sets[i]), min((d for d in ids if d is not None), default=None)))
    return sorted(((d, n, c, d == c) for d, n, c in out), key=str)


def corpus(seed=4):
    rnd = random.Random(seed)
    rows = []
    for d in range(25):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(6, 200))]
        rows.append((d, " ".join(w)))
        for k in range(1, 5):
            v = list(w)
            for at in rnd.sample(range(len(v)), rnd.randint(1, max(2, len(v) // 40))):
                v[at] = "Edit"
            rows.append((100 * k + d, "\n".join(v)))
    # a chain: each is near the next only
    w = [f"c{i}" for i in range(300)]
    for k in range(12):
        rows.append((1000 - k, " ".join(w)))
        w = w[15:] + [f"c{300 + 15 * k + i}" for i in range(15)]
    # a passage that many share, beside words of their own: similar, but not enough
    shared = [f"p{i}" for i in range(120)]
    rows += [(2000 + d, " ".join([*shared, *[f"o{d}x{i}" for i in range(25)]])) for d in range(60)]
    rows += [(900, rows[3][1]), (901, None), (902, ""), (903, "two words"), (904, "Two  words"), (905, "words two"), (None, rows[3][1]), (None, "no id has this"), (None, None), (901, None), (903, "two words"), (906, " "), (907, " \t\n")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,large,bands", [(512, 4096, 50), (7, 30, 350), (5, 10_000, 350)])
def test_against_brute_force(spark, monkeypatch, block, large, bands):
    """With one coordinate a band, the many that share a passage meet in large buckets."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "LARGE", large)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sid", "2 as size", "'k' as key").repartition(3)
    got = M.minhash_components(df, bands=bands).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_empty_and_unlinked(spark):
    assert M.minhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = M.minhash_components(spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_long_text(spark):
    w = [f"w{i % 5003}x{i % 17}" for i in range(200_000)]
    rows = [(7, " ".join(w)), (3, " ".join(w[:-5])), (5, " ".join(w[: len(w) // 3]))]
    got = {r.doc_id: r.component_id for r in M.minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c, _ in brute(rows)}


def plain_sketch(values, t):
    """Round by round, element by element."""
    out = [None] * t
    for r in range(2 * t):
        for x in values:
            h = int(M.T.mix(np.array([x], np.uint64) ^ M._SEED[r])[0])
            b = (h >> 48) * t >> 16 if r < t else r - t
            if out[b] is None or out[b] >= r << 48:
                v = r << 48 | h & (1 << 48) - 1
                out[b] = v if out[b] is None else min(out[b], v)
        if None not in out:
            break
    return out


def test_sketch_against_definition():
    rng = np.random.RandomState(1)
    sizes = [0, 1, 2, 7, 30, 200]
    value = np.concatenate([np.sort(rng.randint(0, 2**63, n).astype(np.uint64)) for n in sizes])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = M.sketches(value, bounds, 20)
    for i, n in enumerate(sizes):
        if n:
            assert got[i].tolist() == plain_sketch(value[bounds[i] : bounds[i + 1]].tolist(), 20)
    assert (got[0] == np.uint64(2**64 - 1)).all()


def test_shares_of_equal_coordinates():
    """The mean share is the similarity, and no share is far from it."""
    rng = np.random.RandomState(2)
    for same, own in ((80, 10), (8, 1), (800, 100)):
        pairs = []
        for _ in range(150):
            x = rng.randint(0, 2**63, same + 2 * own).astype(np.uint64)
            pairs += [np.sort(x[: same + own]), np.sort(np.concatenate((x[:same], x[same + own :])))]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in pairs])))
        s = M.sketches(np.concatenate(pairs), bounds)
        share = (s[::2] == s[1::2]).mean(axis=1)
        assert share.mean() == pytest.approx(0.8, abs=0.012)
        assert abs(share - 0.8).max() < 5 * (0.16 / M.COORDINATES) ** 0.5 or same == 8
