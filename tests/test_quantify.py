"""Simulated fragments through the whole run, and the stages on cases worked out by hand."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraglens import config as C
from fraglens import quantify as Q
from fraglens.operators import estimation as E
from fraglens.operators import resolution as R
from fraglens.operators import simulate as M
from fraglens.operators import training as T
from fraglens.sources import annotation as N


def exon(g, t, strand, s, e, ref="chr1"):
    return f'{ref}\tx\texon\t{s + 1}\t{e}\t.\t{strand}\t.\tgene_id "{g}"; transcript_id "{t}";'


GENES = [
    *[exon("g1", "t1", "+", s, e) for s, e in ((1000, 1500), (2500, 3000), (4000, 4600))], *[exon("g1", "t2", "+", s, e) for s, e in ((1000, 1500), (4000, 4600))],
    *[exon("g2", "t3", "-", s, e) for s, e in ((8000, 8800), (10000, 10900))], exon("g3", "t4", "+", 15000, 16200),
]


@pytest.fixture(scope="module")
def index(spark):
    got = Q.index(N.parse_gtf(spark.createDataFrame([(x,) for x in GENES], "value string"))).cache()
    got.count()
    return got


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame([("chr1", 30000)], "ref string, length long")


def run(index, refs, mrna, nrna, gdna, abundance=None, config=C.QuantConfig(), **sim):
    a = F.coalesce(*[F.when(F.col("t_id") == k, float(v)) for k, v in (abundance or {}).items()], F.lit(10.0))
    t = index.withColumns({"abundance": a, "nrna_abundance": F.when(F.size("exons") > 1, 1.0).otherwise(0.0)})
    rows = M.paired_records(M.fragments(t, refs, mrna, nrna, gdna, M.SimConfig(**sim)))
    got = Q.quantify(rows, index, config)
    want = {(r.pool, r.t_id): r.n for r in M.truth(rows).collect()}
    f = got.summary["fragments"]
    t = got.summary["totals"]
    assert t["mrna"] + t["nrna"] + t["gdna"] + f["n_chimeric"] + f["n_gated"] == pytest.approx(f["n_fragments"], abs=1e-6 * f["n_fragments"])
    return got, {r.transcript_id: r["count"] for r in got.tables["quant"].collect()}, want


def test_clean(index, refs):
    got, counts, want = run(index, refs, 1500, 0, 0)
    assert got.summary["strand"]["p_sense"] == 1.0 and got.models.strand.read1_sense
    for t in ("t1", "t2", "t3", "t4"):
        assert counts[t] == pytest.approx(want["mrna", t], rel=0.12, abs=10)
    quant = {r.transcript_id: r for r in got.tables["quant"].collect()}
    assert sum(r.tpm for r in quant.values()) == pytest.approx(1e6)
    genes = {r.gene_id: r for r in got.tables["gene_quant"].collect()}
    assert genes["g1"]["count"] == pytest.approx(counts["t1"] + counts["t2"]) and genes["g1"].n_transcripts == 2
    assert got.summary["totals"]["gdna"] < 100
    outcome = {r.qname: r for r in got.annotations.collect()}
    assert len(outcome) == 1500
    assert sum(r.t_id is not None and r.qname.startswith(r.t_id + ":") for r in outcome.values()) > 1200


@pytest.mark.parametrize("mode", ["fractional", "map"])
def test_mixed_and_antisense_protocol(index, refs, mode):
    config = C.resolve({"assignment_mode": mode})[0]
    got, counts, want = run(index, refs, 1200, 0, 600, {"t2": 0, "t1": 30}, config, strand_specificity=0.05)
    assert not got.models.strand.read1_sense and got.models.strand.specificity > 0.9
    assert counts["t1"] > 5 * counts["t2"]
    assert got.summary["totals"]["gdna"] == pytest.approx(600, rel=0.3)
    assert got.models.quality == "good"
    loci = got.tables["loci"].collect()
    assert sorted(r.locus_id for r in loci) == list(range(len(loci)))
    assert {r.nrna_id.split("_")[0] for r in got.tables["nrna_quant"].collect()} == {"FRAGLENS"}


def test_nascent(index, refs):
    got, _, _ = run(index, refs, 800, 400, 0, config=C.resolve({"assignment_mode": "fractional"})[0])
    assert got.summary["totals"]["nrna"] > 100


def test_large_loci_take_the_other_way(index, refs):
    one = C.resolve({"assignment_mode": "fractional"})[0]
    two = dataclasses.replace(one, em=dataclasses.replace(one.em, mega_rows=10))
    a, b = run(index, refs, 600, 50, 100, config=one)[1], run(index, refs, 600, 50, 100, config=two)[1]
    assert a.keys() == b.keys()
    for t in a:
        assert a[t] == pytest.approx(b[t], rel=1e-3, abs=0.05)


def test_nothing(index, refs, spark):
    got = Q.quantify(spark.createDataFrame([], N.ALIGNMENT_SCHEMA), index)
    assert got.models.quality == "fallback" and got.summary["fragments"]["n_fragments"] == 0
    assert {r["count"] for r in got.tables["quant"].collect()} == {0.0}


def aligned(spark, rows):
    full = [(n, 99 if k == 0 else 147, ref, pos, 60, cig, ref, pos, nm, nh, hi, xs, None) for n, nm, nh, hi, xs, ends in rows for k, (ref, pos, cig) in enumerate(ends)]
    return spark.createDataFrame(full, N.ALIGNMENT_SCHEMA)


def test_chimeras_artifacts_and_implicit_splices(index, spark):
    rows = [
        ("far", 0, 1, -1, None, [("chr1", 1100, "100M"), ("chr1", 15100, "100M")]), ("other", 0, 1, -1, None, [("chr1", 1100, "100M"), ("chr2", 100, "100M")]),
        ("gap", 1, 1, -1, None, [("chr1", 1400, "100M"), ("chr1", 2500, "100M")]), ("bad", 0, 1, -1, None, [("chr1", 1100, "50M100N50M"), ("chr1", 1250, "50M")]),
        ("new", 0, 1, -1, "+", [("chr1", 1100, "50M77N50M"), ("chr1", 1300, "50M")]),
    ]
    bl = spark.createDataFrame([("chr1", 1150, 1250, 60, 60)], "ref string, start int, end int, max_anchor_left int, max_anchor_right int")
    got = {r.qname: r for r in R.resolve_all(aligned(spark, rows), index, bl).collect()}
    assert (got["far"].chimera, got["far"].chimera_gap) == (R.CIS_OTHER_STRAND if got["far"].strand == 3 else R.CIS_SAME_STRAND, 13900)
    assert got["other"].chimera == R.TRANS
    assert got["gap"].splice_type == R.SPLICED_IMPLICIT and got["gap"].nm == 2
    assert got["bad"].splice_type == R.SPLICE_ARTIFACT
    assert got["new"].splice_type == R.SPLICED_UNANNOT
    assert all(c.frag_length == -1 for c in got["far"].candidates)


@pytest.mark.parametrize(
    "start,end,want",
    [(1500, 5500, 1001), (994, 5600, 1607), (1500, 6005, 1506), (996, 6003, 2008), (1600, 2005, 405), (1855, 5149, 295)],
)
def test_fold_position(spark, start, end, want):
    df = spark.createDataFrame([([(999, 2000), (4999, 6000)], start, end)], "exons array<struct<start:int,end:int>>, fs int, fe int")
    assert df.select(F.expr(f"abs({R.fold_position('exons', 'fe')} - {R.fold_position('exons', 'fs')})").alias("x")).first().x == want


def test_settings():
    c, unknown = C.resolve({"em_mode": "map", "seed": None, "keep_duplicates": True}, {"seed": 7, "em_mode": "vbem", "odd": 1})
    assert (c.em.mode, c.em.seed, c.scan.skip_duplicates, unknown) == ("map", 7, False, ["odd"])
    assert C.resolve({"overhang_alpha": 0.0})[0].scoring.overhang_log_penalty == float("-inf")


def test_strand_model():
    m = T.StrandModel(95, 5)
    assert m.p_sense == 0.95 and T.StrandModel(0, 0).p_sense == 0.5
    assert T.StrandModel(100, 0).minority_bound() == pytest.approx(1 - 0.01 ** (1 / 101), abs=1e-9)
    assert T.StrandModel(0, 0).minority_bound() == 0.5 == T.StrandModel(2, 2).minority_bound()
    # Beta(6, 96) at 0.95 and Beta(3, 9) at 0.99, from published tables of the binomial.
    x = T.StrandModel(95, 5).minority_bound(0.95)
    assert sum(__import__("math").comb(101, i) * x**i * (1 - x) ** (101 - i) for i in range(6)) == pytest.approx(0.05, abs=1e-9)
    assert T.StrandModel(9_000_000, 1_000_000).minority_bound() == pytest.approx(0.1, abs=3e-4)


def test_length_model():
    h = np.zeros(101)
    assert T.LengthModel(h).log_table()[3] == pytest.approx(-np.log(101))
    assert E.softmax_rows(np.array([0.0, 0.0, -np.inf]), np.array([2, 1])).tolist() == [0.5, 0.5, 0.0]


def test_truncated_normal_fills_its_bounds(spark):
    """No spike at the mean, whatever the bounds; the mean and spread of the normal between wide ones."""
    low, high = F.lit(-1000), F.lit(1000)
    r = spark.range(20000).select(M.truncated_normal(1, "x", 200.0, 30.0, low, high, "id").alias("w"), M.truncated_normal(1, "y", 200.0, 30.0, F.lit(280), F.lit(283), "id").alias("t"), M.truncated_normal(1, "z", 200.0, 30.0, F.lit(7), F.lit(7), "id").alias("o"))
    x = r.toPandas()
    assert x.w.mean() == pytest.approx(200, abs=1) and x.w.std() == pytest.approx(30, rel=0.03)
    assert set(x.t) == {280, 281, 282, 283} and (x.t == 280).mean() < 0.5
    assert set(x.o) == {7}


def test_posterior_mean_in_any_order(spark):
    """The mean is that of the exact sums, to the last bit, in whatever order its posteriors are added."""
    from fraglens.operators import report

    none = spark.createDataFrame([], "t_index int, count_col int, n long")
    hundredths = [4] * 30 + [8] * 54 + [10] * 28 + [5] * 32
    n, nn = sum(hundredths), sum(x * x for x in hundredths)
    for seed in range(6):
        order = hundredths[:]
        random.Random(seed).shuffle(order)
        rows = spark.createDataFrame([(7, k % 3, 1.0, x / 100) for k, x in enumerate(order)], "comp int, count_col int, weight double, posterior double").repartition(3)
        got = report.transcript_counts(none, rows).collect()
        assert [(r.t_index, r.posterior_mean) for r in got] == [(7, (nn / 1e4) / (n / 1e2))]
