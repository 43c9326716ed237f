"""Chunks of references, what is cut out of them, reads back at their places, and draws."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraglens import cli
from fraglens.operators import draws
from fraglens.operators import sequences as Q
from fraglens.operators import simulate as M
from fraglens.plans import catalogue
from tests.test_quantify import GENES


def genome(seed=1):
    rnd = random.Random(seed)
    return {f"c{i}": "".join(rnd.choice("ACGT") for _ in range(n)) for i, n in enumerate((20_000, 37, 8000, 1, 12_345))}


def fasta(seqs, width=71):
    return "\n".join("\n".join([f">{n} some words", *(s[i : i + width].lower() if i % 3 else s[i : i + width] for i in range(0, len(s), width)), ""]) for n, s in seqs.items())


def joined(chunks):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.ref, r.chunk)):
        assert r.chunk * Q.CHUNK == len(out.get(r.ref, ""))
        out[r.ref] = out.get(r.ref, "") + r.sequence
    return out


@pytest.mark.parametrize("split", [128 << 20, 3000, 700])
def test_fasta_in_splits(spark, tmp_path, split):
    a, b = genome(), {"other": "ACGTN" * 3000}
    (tmp_path / "a.fa").write_text(fasta(a))
    (tmp_path / "b.fa").write_text(fasta(b, 60))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        chunks = Q.read_fasta(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert joined(chunks) == a | b
    Q.write_fasta(chunks, f"{tmp_path}/out")
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    want = "".join(f">{n}\n" + "".join(s[i : i + 80] + "\n" for i in range(0, len(s), 80)) for n, s in sorted((a | b).items()))
    assert text == want
    for r in Q.fasta_index(chunks).collect():
        assert text[r.offset : r.offset + min(r.length, r.bases)] == (a | b)[r.ref][: r.bases] and r.length == len((a | b)[r.ref])


def test_blocks_and_transcripts_and_edits(spark):
    g = genome()
    runs = spark.createDataFrame([(n, at, s[at : at + 3333]) for n, s in g.items() for at in range(0, len(s), 3333)], "ref string, start long, sequence string").repartition(4)
    chunks = Q.chunked(runs)
    assert joined(chunks) == g
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        ref = rnd.choice(["c0", "c4"])
        at = sorted(rnd.sample(range(len(g[ref])), 2 * rnd.randint(1, 4)))
        rows.append((f"t{k}", ref, at[0], at[-1], rnd.choice([1, 2]), [(at[i], at[i + 1]) for i in range(0, len(at), 2)]))
    t = spark.createDataFrame(rows, "t_id string, ref string, start int, end int, strand int, exons array<struct<start:int,end:int>>")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for spliced in (True, False):
        got = {r.t_id: r.sequence for r in Q.transcript_sequences(t, chunks, spliced).collect()}
        for n, ref, s, e, strand, exons in rows:
            want = "".join(g[ref][a:b] for a, b in exons) if spliced else g[ref][s:e]
            assert got[n] == (turn(want) if strand == 2 else want)
    made = joined(Q.edited(chunks, Q.splice_motifs(t.filter("t_id = 't1'"))))
    ref, strand, exons = rows[1][1], rows[1][4], rows[1][5]
    for (_, a), (b, _) in zip(exons, exons[1:]):
        if b - a >= 4:
            assert (made[ref][a : a + 2], made[ref][b - 2 : b]) == (("CT", "AC") if strand == 2 else ("GT", "AG"))
    assert sum(x != y for x, y in zip(made[ref], g[ref])) <= 4 * len(exons)
    with pytest.raises(Exception, match="beyond"):
        Q.edited(chunks, spark.createDataFrame([("c1", 36, "AA", 1)], "ref string, pos long, bases string, i int")).collect()


def test_random_bases(spark):
    refs = spark.createDataFrame([("a", 20_000), ("b", 5)], "ref string, length long")
    got = joined(Q.random_chunks(refs, 7, gc=0.2))
    assert got == joined(Q.random_chunks(refs.repartition(7), 7, gc=0.2)) and {n: len(s) for n, s in got.items()} == {"a": 20_000, "b": 5}
    assert sum(c in "GC" for c in got["a"]) / 20_000 == pytest.approx(0.2, abs=0.02)


def test_reads_of_a_simulation_are_where_their_names_say(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.gtf").write_text("\n".join(GENES))
    seq = "".join(random.Random(5).choice("ACGT") for _ in range(30_000))
    (tmp_path / "g.fa").write_text(fasta({"chr1": seq}))
    (tmp_path / "g.fai").write_text("chr1\t30000\t6\t71\t72\n")
    cli.main(["index", "--gtf", f"{d}/a.gtf", "--out", f"{d}/index"], spark)
    cli.main(["sim", "--index", f"{d}/index", "--references", f"{d}/g.fai", "--genome", f"{d}/g.fa", "--out", f"{d}/rows", "--mrna", "400", "--nrna", "100", "--gdna", "100", "--strand-specificity", "0.8", "--strand-kappa", "2", "--fastq", f"{d}/fq", "--bam", f"{d}/sim.bam"], spark)
    exons, strands = {}, {}
    for line in GENES:
        _, _, _, s, e, _, strand, _, attrs = line.split("\t")
        t = re.search('transcript_id "(.*?)"', attrs)[1]
        exons.setdefault(t, []).append((int(s) - 1, int(e)))
        strands[t] = strand
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    mates = []
    for k in (1, 2):
        lines = "".join(f.read_text() for f in sorted((tmp_path / f"fq/R{k}").glob("part-*"))).splitlines()
        assert all(x == "+" for x in lines[2::4]) and all(set(q) == {"I"} and len(q) == len(s) for s, q in zip(lines[1::4], lines[3::4]))
        mates.append(list(zip(lines[::4], lines[1::4])))
    assert len(mates[0]) == 600 and [n[:-2] for n, _ in mates[0]] == [n[:-2] for n, _ in mates[1]]
    swapped = 0
    for (name, r1), (_, r2) in zip(*mates):
        who, *place, span, strand, _ = name[1:-2].split(":")
        s, e = map(int, span.split("-"))
        if who == "gdna":
            whole = seq[s:e] if strand == "f" else turn(seq[s:e])
        else:
            t = who.removeprefix("nrna_")
            x = "".join(seq[a:b] for a, b in exons[t]) if not who.startswith("nrna_") else seq[exons[t][0][0] : exons[t][-1][1]]
            whole = (turn(x) if strands[t] == "-" else x)[s:e]
        n = min(100, len(whole))
        want = turn(whole[-n:]), whole[:n]
        assert (r1, r2) in (want, want[::-1])
        swapped += (r1, r2) != want
    assert 40 < swapped < 160
    from fraglens.sources import bam

    assert bam.read_bam(spark, f"{d}/sim.bam").count() == 1200 == spark.read.parquet(f"{d}/rows").count()


def test_errors(spark):
    df = spark.range(400).select("id", F.repeat(F.lit("A"), F.lit(500)).alias("s"))
    got = df.select("id", "s", Q.with_errors("s", 0.1, 3, "id").alias("e"), Q.with_errors("s", 0.0, 3, "id").alias("z"))
    a, b = got.collect(), got.repartition(7).orderBy("id").collect()
    assert [r.e for r in a] == [r.e for r in b] and all(r.z == r.s for r in a)
    every = "".join(r.e for r in a)
    assert len(every) == 200_000
    for c in "CGT":
        assert every.count(c) / 200_000 == pytest.approx(0.025, rel=0.08)


# -- draws ------------------------------------------------------------------


def counted(df, **kw):
    return {r.id: r.n for r in draws.multinomial(df, "w", kw.get("total", 100_000), ["id"], kw.get("seed", 1), "n").collect()}


@pytest.mark.parametrize("bits", [10, 3])
def test_multinomial(spark, monkeypatch, bits):
    """Totals are exact, partitions change nothing, and counts are as scattered as draws are."""
    monkeypatch.setattr(draws, "BITS", bits)
    df = spark.range(200).selectExpr("id", "cast(id % 10 as double) as w")
    got = counted(df)
    assert sum(got.values()) == 100_000 and len(got) == 200
    assert got == counted(df.repartition(7)) == counted(df.orderBy(F.desc("id")).coalesce(1))
    assert got != counted(df, seed=2)
    chi = 0.0
    for k, n in got.items():
        want = 100_000 * (k % 10) / 900
        assert n == 0 or want
        chi += (n - want) ** 2 / want if want else 0
    assert 120 < chi < 250  # 179 degrees of freedom
    assert sum(counted(df.withColumn("w", F.lit(0.0))).values()) == 100_000
    assert set(counted(df, total=0).values()) == {0} and counted(df.limit(0)) == {}


def test_binomial_moments_of_the_tree():
    w = np.array([1, 2, 3, 10])
    got = np.array([draws.split(50, w, s, 0, 0) for s in range(3000)])
    p = w / w.sum()
    assert (got.sum(axis=1) == 50).all()
    assert np.abs(got.mean(axis=0) - 50 * p).max() < 0.25
    assert np.abs(np.cov(got.T) - 50 * (np.diag(p) - np.outer(p, p))).max() < 1.2


def test_shards(spark):
    df = spark.range(100).selectExpr("id", "id % 7 + 1 as n")
    got = draws.shards(df, "n", ["id"], 4).orderBy("id").collect()
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    loads = [sum(r.n for r in got if r.shard == k) for k in range(4)]
    assert max(loads) - min(loads) <= 14


def test_beta_functions():
    x = np.linspace(0, 1, 41)
    assert np.allclose(draws.beta_cdf(2, 2, x), 3 * x**2 - 2 * x**3, atol=1e-12)
    assert np.allclose(draws.beta_cdf(1, 1, x), x, atol=1e-12)
    assert np.allclose(draws.beta_cdf(0.5, 0.5, x), 2 / math.pi * np.arcsin(np.sqrt(x)), atol=1e-10)
    u = np.linspace(0.001, 0.999, 99)
    for a in (0.25, 0.7, 3.0, 400.0):
        assert np.allclose(draws.beta_cdf(a, a, draws.beta_quantile(u, a, a)), u, atol=1e-5)


@pytest.mark.parametrize("kappa", [0.5, 6.0, 100.0])
def test_strand_shares_of_regions(spark, kappa):
    exons = [(i, [(50 * k, 50 * k + 20) for k in range(20 * i, 20 * i + 20)]) for i in range(100)]
    t = spark.createDataFrame(exons, "i int, exons array<struct<start:int,end:int>>").selectExpr("'chr1' as ref", "exons", "false as is_synthetic")
    refs = spark.createDataFrame([("chr1", 100_100)], "ref string, length long")
    c = M.SimConfig(seed=9, strand_kappa=kappa)
    rows = M.strand_regions(t, refs, c).orderBy("start").collect()
    assert rows == M.strand_regions(t.repartition(5), refs, c).orderBy("start").collect()
    assert rows[0].start == 0 and rows[-1].end == 100_100 and all(a.end == b.start for a, b in zip(rows, rows[1:]))
    p = np.array([r.p_plus for r in rows])
    assert len(p) > 3000 and p.mean() == pytest.approx(0.5, abs=0.03)
    assert p.var() == pytest.approx(1 / (4 * (kappa + 1)), rel=0.1)


def test_genomic_fragments_follow_their_regions(spark):
    t = spark.createDataFrame([("chr1", [(10_000, 20_000)], False)], "ref string, exons array<struct<start:int,end:int>>, is_synthetic boolean")
    refs = spark.createDataFrame([("chr1", 30_000)], "ref string, length long")
    c = M.SimConfig(seed=11, strand_kappa=0.2)
    f = M.fragments(t.withColumns({"abundance": F.lit(0.0), "nrna_abundance": F.lit(0.0)}), refs, 0, 0, 6000, c)
    shares = {r.start: r.p_plus for r in M.strand_regions(t, refs, c).collect()}
    by = f.select((F.floor(F.col("blocks")[0].start / 10_000) * 10_000).alias("r"), (F.col("strand") == 1).cast("int").alias("plus")).groupBy("r").agg(F.avg("plus").alias("p"), F.count("*").alias("n")).collect()
    assert {r.r for r in by} == set(shares) and sum(r.n for r in by) == 6000
    for r in by:
        assert r.p == pytest.approx(shares[r.r], abs=0.05)


def test_chunks_are_not_broadcast(spark):
    """Chunks made by an explode look small to the planner, however large they are; they meet their blocks in a sort-merge join."""
    runs = spark.createDataFrame([("c", 0, "ACGT" * 10)], "ref string, start long, sequence string")
    t = spark.createDataFrame([("t", "c", 1, 9, 1, [(1, 3), (6, 9)])], "t_id string, ref string, start int, end int, strand int, exons array<struct<start:int,end:int>>")
    got = Q.transcript_sequences(t, Q.chunked(runs, 5), True, 5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.sequence for r in got.collect()] == ["CGGTA"]


@pytest.mark.parametrize("reach", [0, 1, 9])
def test_both_sequences_from_one_join(spark, reach):
    """A span meets chunks once for both sequences, whatever the reach of a row of chunks; equal rows are one, exons and spans beyond the reference are cut or left out."""
    runs = spark.createDataFrame([("a", 0, "ACGTTGCAAC"), ("a", 10, "GGTCA"), ("b", 0, "TTT")], "ref string, start long, sequence string")
    rows = [(1, "a", 2, 13, 1, [(8, 13), (2, 4)]), (1, "a", 2, 13, 1, [(8, 13), (2, 4)]), (2, "a", 2, 13, 2, [(2, 4), (8, 13)]), (3, "a", 12, 20, 1, [(12, 14), (14, 20)]), (4, "b", 3, 9, 1, [(3, 9)]), (5, "a", 0, 5, 2, [(0, 5)]), (6, "b", 1, 9, 1, [(5, 9)])]
    t = spark.createDataFrame(rows, "k int, ref string, start int, end int, strand int, exons array<struct<start:int,end:int>>")
    got = Q.spliced_and_whole(t, Q.chunked(runs, 4), ["k"], 4, reach)
    assert sorted(map(tuple, got.collect())) == [(1, "GTACGGT", "GTTGCAACGGT"), (2, "ACCGTAC", "ACCGTTGCAAC"), (3, "TCA", "TCA"), (5, "AACGT", "AACGT")]


def test_near_spans_exchange_no_bases(spark):
    """Sequences are not grouped by transcript but for spans beyond the reach; both together are two joins."""
    query = catalogue.queries()["transcript_sequences"](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("collect_set(") == 1 and all(f"RepartitionByExpression [{c}" in plan for c in ("ref", "p_partkey"))
