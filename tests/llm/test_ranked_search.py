import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fraglens.llm import ranked_search as R

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, length in bags:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)))
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, d, s) for rank, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=0, n=400):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(d, " ".join(rnd.choices(words, k=rnd.randint(1, 120)))) for d in range(n)]
    docs += [(n + i, docs[i % 7][1].upper()) for i in range(40)]  # ties
    docs += [(900_000, None), (900_001, ""), (900_002, "... !"), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (900_003, "Été naïve 日本語 w1 été"), (900_004, "w2 " * 20_000)]
    items = [(f"q{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 25)))) for i in range(30)]
    items += [("none", None), ("empty", ""), ("unknown", "zzz"), ("été", "ÉTÉ Été 日本語"), ("q0", "w1 W1 w1"), (None, "w2 w3")]
    rnd.shuffle(docs)
    return docs, items


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as shard").repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as rank")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in R.search(R.build_index(d), q, **kw).collect()), key=str)


@pytest.mark.parametrize("shard,first,piece", [(8 << 20, 256, None), (3000, 4, None), (20_000, 1, 60)])
def test_against_brute(spark, monkeypatch, shard, first, piece):
    monkeypatch.setattr(R, "SHARD_BYTES", shard)
    monkeypatch.setattr(R, "FIRST_RANGE", first)
    docs, items = corpus()
    assert found(spark, docs, items, piece=piece) == brute(docs, items)


def test_few_documents_and_empty_tables(spark):
    docs = [(2, "a b"), (1, "b a"), (3, "c")]
    items = [("x", "a"), ("y", "c a b")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] == found(spark, docs, [])


def test_bounds_open_few_lists(monkeypatch):
    """Once ten good documents are known, lists of low bounds are probed for candidates only, and none is opened beyond reach."""
    rng = np.random.RandomState(0)
    rare = np.sort(rng.choice(100_000, 300, False)).astype(np.int32)
    lists = [(np.arange(100_000, dtype=np.int32), np.full(100_000, 5)), (rare, rng.randint(500, 1000, 300))]
    best = R.Best(10)
    seen = []
    monkeypatch.setattr(R.Best, "add", lambda self, s, ids, f=R.Best.add: (seen.append(len(ids)), f(self, s, ids))[1])
    R.max_score(lists, 100_000, list(range(100_000)), best)
    want = sorted(((-(c + 5), d) for d, c in zip(rare.tolist(), lists[1][1].tolist())))[:10]
    assert [(-s, d) for s, d in best.rows] == want
    before = len(seen)
    R.max_score([(lists[0][0], np.full(100_000, 5))], 100_000, list(range(100_000)), best)
    assert len(seen) == before


def test_norm_beyond_64_bits():
    assert R.length_norm(np.array([10**7, 3]), 10**12, 10**15).tolist() == [10 + 90 * 10**7 * 10**12 // 10**15, 10 + 90 * 3 * 10**12 // 10**15]
