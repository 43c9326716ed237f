"""Annotation, fragments and estimation on small cases worked out by hand."""

import numpy as np
import pytest

from fraglens.operators import annotation as A
from fraglens.operators import estimation as E
from fraglens.operators import fragments as G
from fraglens.operators import histograms as H
from fraglens.operators import resolution as R
from fraglens.sources import annotation as N
from fraglens.sources import sinks


def exon(g, name, t, strand, s, e):
    return f'chr1\tx\texon\t{s + 1}\t{e}\t.\t{strand}\t.\tgene_id "{g}"; transcript_id "{t}"; gene_name "{name}"; tag "basic"; tag "CCDS";'


MINI = [
    "#comment", "", *[exon("g1", "GeneA", "t1", "+", s, e) for s, e in ((99, 200), (299, 400), (499, 600))], *[exon("g1", "GeneA", "t2", "+", s, e) for s, e in ((99, 200), (499, 600))],
    *[exon("g2", "GeneB", "t3", "-", s, e) for s, e in ((999, 1100), (1199, 1300))],
]


@pytest.fixture
def index(spark):
    return A.number(N.transcripts(N.parse_gtf(spark.createDataFrame([(x,) for x in MINI], "value string"))))


def test_transcripts_and_ids(index):
    rows = {r.t_id: r for r in index.collect()}
    assert [(rows[t].t_index, rows[t].g_index, rows[t].length, rows[t].strand) for t in ("t1", "t2", "t3")] in ([(0, 0, 303, 1), (1, 0, 202, 1), (2, 1, 202, 2)],)
    assert all(r.is_basic and r.is_ccds and not r.is_mane for r in rows.values())
    assert {(g.g_id, g.start, g.end, g.n_transcripts) for g in A.genes(index).collect()} == {("g1", 99, 600, 2), ("g2", 999, 1300, 1)}


def test_nascent_intergenic_junctions(index, spark):
    got = {(r.ref, r.strand, r.start, r.end, r.n_contributors) for r in A.nascent_spans(index).collect()}
    assert got == {("chr1", 1, 99, 600, 2), ("chr1", 2, 999, 1300, 1)}
    lengths = spark.createDataFrame([("chr1", 2000), ("chr2", 500)], "ref string, length long")
    assert {tuple(r) for r in A.intergenic(index, lengths).collect()} == {("chr1", 0, 99), ("chr1", 600, 999), ("chr1", 1300, 2000), ("chr2", 0, 500)}
    assert {(r.start, r.end, r.t_index) for r in A.junctions(index).collect()} == {(200, 299, 0), (400, 499, 0), (200, 499, 1), (1100, 1199, 2)}
    assert A.transcript_intervals(index).count() == 10


def test_strict_and_skip(spark):
    bad = spark.createDataFrame([("chr1\tx\texon",), (MINI[2],)], "value string")
    assert N.parse_gtf(bad, "skip").count() == 1
    with pytest.raises(Exception, match="bad annotation line"):
        N.parse_gtf(bad).collect()


def test_bed_and_gtf_lines(index, spark):
    lines = {r.value.split("\t")[3]: r.value.split("\t") for r in sinks.bed12(index).collect()}
    assert lines["t1"][9:] == ["3", "101,101,101", "0,200,400"]
    again = N.transcripts(N.parse_gtf(sinks.gtf_lines(index)))
    assert {(r.t_id, r.start, r.end) for r in again.collect()} == {("t1", 99, 600), ("t2", 99, 600), ("t3", 999, 1300)}


def test_blacklist(spark):
    rows = [("chr1", 100, 500, "+", 50, 5, 8, 12), ("chr1", 100, 500, "+", 75, 3, 12, 9), ("chr1", 100, 500, "+", 100, 7, 15, 6), ("chr1", 100, 500, "+", 125, 4, 10, 18), ("chr1", 50, 80, "+", 50, 1, 99, 99)]
    df = spark.createDataFrame(rows, "chrom string, intron_start int, intron_end int, strand string, read_length int, count int, max_anchor_left int, max_anchor_right int")
    assert [tuple(r) for r in N.splice_blacklist(df).collect()] == [("chr1", 100, 500, 15, 18)]


def test_cigar(spark):
    b, j = G.cigar_blocks("cigar", "pos")
    r = spark.createDataFrame([("5S50M200N10I40M2D10M3H", 100)], "cigar string, pos int").select(b.alias("b"), j.alias("j")).first()
    assert [tuple(x) for x in r.b] == [(100, 150), (350, 402)]
    assert [tuple(x) for x in r.j] == [(150, 350, 50, 52)]


def test_resolution(index, spark):
    # name, blocks, junction, splice type, candidates
    cases = [("a", 150, "50M99N51M", "+", 2, [0]), ("b", 150, "50M99N51M", None, 2, [0]), ("c", 150, "50M299N51M", "+", 2, [1]), ("d", 120, "60M", None, 0, [0, 1]), ("e", 320, "60M", None, 0, [0, 1])]
    rows = [(n, 99 if k == 0 else 147, "chr1", pos, 60, cig, "chr1", pos, 0, 1, -1, xs, None) for n, pos, cig, xs, _, _ in cases for k in (0, 1)]
    rows += [("dup", 0x400 | 1, "chr1", 150, 60, "50M", "chr1", 1, 0, 1, -1, None, None)]
    df = spark.createDataFrame(rows, N.ALIGNMENT_SCHEMA)
    annotated = A.with_nascent(index)
    got = {r.qname: (r.splice_type, [c.t_index for c in r.candidates if not c.is_synthetic]) for r in R.resolve_all(df, annotated).collect()}
    assert got == {n: (k, c) for n, _, _, _, k, c in cases}


def test_unpaired_is_an_error(spark):
    df = spark.createDataFrame([("x", 0, "chr1", 1, 60, "5M", "*", 0, 0, 1, -1, None, None)], N.ALIGNMENT_SCHEMA)
    with pytest.raises(Exception, match="paired"):
        G.usable(df).collect()


@pytest.mark.parametrize("mode", ["vbem", "map"])
def test_locus_em(mode):
    unit, comp = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1] * 3)
    theta, post = E.locus_em(3, unit, comp, np.zeros(6), np.array([20.0, 10, 0]), np.array([0.5, 0.5, 0]) if mode == "vbem" else np.zeros(3), mode)
    assert 1.5 < theta[0] / theta[1] < 3
    assert theta[2] == 0
    assert np.allclose(post.reshape(3, 2).sum(1), 1)
    p = np.random.RandomState(0).permutation(6)
    assert np.allclose(E.locus_em(3, unit[p], comp[p], np.zeros(6), np.array([20.0, 10, 0]), np.array([0.5, 0.5, 0]), mode)[0], E.locus_em(3, unit, comp, np.zeros(6), np.array([20.0, 10, 0]), np.array([0.5, 0.5, 0]), mode)[0])
    skew = E.locus_em(2, np.repeat(np.arange(5), 2), np.array([0, 1] * 5), np.array([-0.1, -5] * 5), np.ones(2), np.full(2, 0.1), mode)[0]
    assert skew[0] > 2 * skew[1]


def test_digamma():
    assert E.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert E.digamma(10.0) == pytest.approx(2.2517525890, abs=1e-9)
    assert E.digamma(0) < -1e299
    assert E.digamma(np.array([0.5, 1e6, 0.01])).tolist() == pytest.approx([-1.9635100260, 13.8155100580, -100.5608854579], abs=1e-8)


def test_mixture():
    rng = np.random.RandomState(1)
    rna = np.bincount(np.clip(rng.normal(200, 30, 20000), 0, 1000).astype(int), minlength=1001)
    gdna = np.bincount(np.clip(rng.normal(350, 60, 6000), 0, 1000).astype(int), minlength=1001)
    pool = np.bincount(np.clip(rng.normal(200, 30, 14000), 0, 1000).astype(int), minlength=1001) + gdna
    pi, g, _ = H.mixture_em(pool, rna)
    assert abs(pi - 0.3) < 0.05
    assert abs(int(g.argmax()) - 350) < 30
    assert H.mixture_em(rna, rna)[0] < 0.05
    assert H.mixture_em(np.zeros(1001), rna)[0] == 0


def test_moments(spark):
    df = spark.createDataFrame([(x,) for x in (200, 200, 200, 250, 250, 300, 900)], "x int")
    r = H.moments(H.dense(df, "x", 500)).first()
    assert (r.total, r.median, r["mode"]) == (6, 200, 200)
    assert r["mean"] == pytest.approx(1400 / 6)
