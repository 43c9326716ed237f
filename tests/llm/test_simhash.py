import random
import re

import numpy as np
import xxhash

from fraglens.llm import simhash as S


def brute_fp(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_codewords():
    x = np.arange(1 << 23, dtype=np.uint32)[:: 37]
    near = S.near_codewords(x)
    assert set((near >= 0).sum(1).tolist()) == {1, 6}
    code = np.flatnonzero(S._remainder(np.arange(1 << 23, dtype=np.uint32)) == 0).astype(np.uint32)
    assert len(code) == 4096
    assert len(set((code >> 11).tolist())) == 4096
    by = {int(c) >> 11: int(c) for c in code}
    for w, row in zip(x[::5000].tolist(), near[::5000].tolist()):
        want = {n for n, c in by.items() if bin(c ^ w).count("1") <= 4}
        assert want == {n for n in row if n >= 0}
        assert bin(by[row[0]] ^ w).count("1") <= 3


def test_keys_meet_for_all_error_patterns():
    rnd = random.Random(0)
    for _ in range(400):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            y ^= 1 << b
        k, row, role = S.keys(np.array([x, y], np.uint64))
        stored = {(int(a), int(r)) for a, r, o in zip(k, row, role) if o != 1}
        probing = {(int(a), int(r)) for a, r, o in zip(k, row, role)}
        assert any((a, 1 - r) in probing for a, r in stored)


def many_near(n=40):
    rnd = np.random.RandomState(0)
    center = rnd.randint(0, 2**62, 20).astype(np.uint64)
    return np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rnd.randint(0, 64, (n, 3)).astype(np.uint64), axis=1) for c in center]))


def test_finer_keys_meet_for_all_error_patterns():
    rnd = random.Random(2)
    for level in range(3):
        for _ in range(150):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                y ^= 1 << b
            k, row = S.finer_keys(np.array([x, y], np.uint64), level)
            assert set(k[row == 0].tolist()) & set(k[row == 1].tolist())


def test_buckets_over_batches(monkeypatch):
    """Links of sorted buckets do not depend on where batches are cut; large buckets give their fingerprints instead."""
    fp = many_near()
    key = np.repeat(np.arange(40, dtype=np.uint64), 20)[: len(fp)]
    key[100:400] = 5
    role = np.full(len(fp), 2, np.int8)
    whole = S._Links(50).take(key, fp, role, True)
    for step in (1, 7, 333):
        links = S._Links(50)
        parts = [links.take(key[i : i + step], fp[i : i + step], role[i : i + step]) for i in range(0, len(fp), step)]
        parts.append(links.take(key[:0], fp[:0], role[:0], True))
        a, b, hot = (np.concatenate(x) for x in zip(*parts))
        assert (a.tolist(), b.tolist()) == (whole[0].tolist(), whole[1].tolist())
        assert set(hot.tolist()) == set(whole[2].tolist()) == set(fp[100:400].tolist())


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    fp = many_near(25)
    want = brute_components({int(x): int(x) for x in fp})
    df = spark.createDataFrame([(int(x) - 2**64 if x >= 2**63 else int(x),) for x in fp], "fp long")
    for small in (4096, 3):
        monkeypatch.setattr(S, "SMALL", small)
        got = {x: x for x in want}
        for a, b in sorted((r.a % 2**64, r.b % 2**64) for r in S.near_links(df).collect()):
            ra, rb = a, b
            while got[ra] != ra:
                ra = got[ra]
            while got[rb] != rb:
                rb = got[rb]
            got[max(ra, rb)] = min(ra, rb)

        def root(x):
            return x if got[x] == x else root(got[x])

        assert {x: root(x) for x in want} == want


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long, 1, "x"), (2, long + " more", 2, "y"), (3, "other text of five words", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, key string").selectExpr("*", "1 as component_id", "2 as root", "3 as least")
    assert sorted((r.doc_id, r.component_id) for r in S.simhash_components(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = ["The", "über", "of", "a", "b", "c", "D", "e"]
    rows = []
    for d in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 4, 5, 40, 200]))]
        rows.append((d, " ".join(w)))
        if len(w) > 30:
            for k in range(2):
                v = list(w)
                v[rnd.randrange(len(v))] = "edit"
                rows.append((100 + 2 * d + k, "\n".join(v)))
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1])]
    got = S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    fps = {d: brute_fp(t) for d, t in rows}
    want = brute_components(fps)
    for r in got:
        assert r.fp % 2**64 == fps[r.doc_id]
        assert r.component_id == want[r.doc_id]


def test_empty(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
