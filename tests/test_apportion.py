"""Apportioning over spans: equal pieces and equal spans meet once."""

import random
from collections import defaultdict

import pytest

from fraglens.operators import intervals as I
from fraglens.plans import catalogue


def test_equal_intervals_are_one_row(spark, monkeypatch):
    rnd = random.Random(2)
    pieces = [(rnd.randrange(2), a, a + 4, rnd.choice([0.5, 1.0, 2.0])) for a in (rnd.randrange(3) * 3 for _ in range(150))]
    spans = [(k, rnd.randrange(2), a, a + 5) for k, a in enumerate(rnd.randrange(2) * 4 for _ in range(90))]
    met, join = [], I.overlap_join
    monkeypatch.setattr(I, "overlap_join", lambda x, y, *rest: (met.extend((x.count(), y.count())), join(x, y, *rest))[1])
    x = spark.createDataFrame(pieces + [(None, 0, 4, 1.0)], "h int, s2 long, e2 long, v double")
    y = spark.createDataFrame(spans + [(90, 0, 1000, 1005)], "o long, g int, s1 long, e1 long")
    got = {r.o: r.share for r in I.overlap_apportion(x, y, [("h", "g")], ("s2", "e2"), ("s1", "e1"), "v", ["o"], 3).collect()}
    want = defaultdict(float)
    for o, g, a, b in spans:
        for h, c, d, v in pieces:
            if g == h and max(a, c) < min(b, d):
                want[o] += v * (min(b, d) - max(a, c)) / (d - c)
    assert got == pytest.approx(dict(want))
    assert met[0] <= 7 and met[1] <= 5


def test_pairs_meet_by_places(spark, monkeypatch):
    """Rows of one place are one until they have met; equal rows count as often as they are there, or once on a distinct side; empty spans meet nothing."""
    met, join = [], I.overlap_join
    monkeypatch.setattr(I, "overlap_join", lambda x, y, *rest: (met.extend((x.count(), y.count())), join(x, y, *rest))[1])
    left = [(i, 1, 0, 10) for i in range(5)] + [(7, 1, 8, 30), (7, 1, 8, 30), (8, 2, 0, 10), (9, 1, 4, 4)]
    right = [(i, 1, 9, 12) for i in range(4)] + [(3, 1, 9, 12), (5, 1, 10, 11), (6, 2, 3, 4), (6, None, 3, 4)]
    x = spark.createDataFrame(left, "a long, g int, s1 long, e1 long")
    y = spark.createDataFrame(right, "b long, h int, s2 long, e2 long")
    want = sorted((p[0], p[2], p[3], q[2], q[3], q[0]) for p in left for q in set(right) if p[1] == q[1] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3])
    got = I.overlap_pairs(x, y, [("g", "h")], ("s1", "e1"), ("s2", "e2"), ("a", "b"), 4, (False, True))
    assert sorted(map(tuple, got.select("a", "s1", "e1", "s2", "e2", "b").collect())) == want
    assert met == [4, 4]


def test_query_meets_by_places(spark):
    """The query's join carries lists of ids, not rows."""
    plan = catalogue.queries()["overlap_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(o_orderkey" in plan and "collect_set(l_orderkey" in plan
