"""Components over every edge, held against a plain union-find."""

import os

import pytest

from fraglens.operators import sets
from fraglens.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_query_over_all_edges(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    got = {r.node: r.component for r in catalogue.queries()["connected_components"](spark, DATA).collect()}
    assert got == plain([(r[0], r[1] + 1000000000) for r in rows])


def test_small_shapes(spark):
    edges = [(1, 1), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8), (8, 10), (2, 3)] + [(100, 101 + k) for k in range(20)] + [(200 + k, 201 + k) for k in range(30)]
    got = {r.node: r.component for r in sets.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == plain(edges)


def test_no_edges(spark):
    assert sets.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
