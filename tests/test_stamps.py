"""Tags of alignment records, through the command line and by hand, and counters of rows and molecules."""

import pytest
from pyspark.sql import functions as F

from fraglens import cli
from fraglens import config as C
from fraglens import quantify as Q
from fraglens.operators import simulate as M
from fraglens.operators import stamps
from fraglens.sources import annotation as N
from fraglens.sources import bam, index_tables
from tests.test_quantify import GENES

REFS = [("chr1", 30000), ("chr9", 500)]


def row(q, flag, pos, cigar="100M", nh=1, hi=-1, xs=None, nm=0):
    return (q, flag, "chr1", pos, 60, cigar, "chr1", pos, nm, nh, hi, xs, None)


def odd_rows():
    """Records that no run counts, hits by number and without, a fragment outside all genes, one of two genes, a rejected junction."""
    return [
        row("a_unmapped", 0x1 | 0x4, 0), row("a_duplicate", 0x1 | 0x400 | 99, 15100), row("a_failed", 0x200 | 99, 15100),
        row("b_two", 99, 1100, nh=2, hi=0), row("b_two", 147, 1300, nh=2, hi=0), row("b_two", 99 | 0x100, 15100, nh=2, hi=1), row("b_two", 147 | 0x100, 15300, nh=2, hi=1),
        row("c_loose", 99, 1100, nh=2), row("c_loose", 147, 1300, nh=2), row("c_loose", 99 | 0x100, 15100, nh=2), row("c_loose", 147 | 0x100, 15300, nh=2),
        row("d_outside", 99, 20000), row("d_outside", 147, 20100), row("e_chimera", 99, 1100), row("e_chimera", 147, 15300), row("f_bad", 99, 1450, "50M1000N50M", xs="+"), row("f_bad", 147, 2600),
    ]


def prepared(spark, tmp_path, **more):
    d = str(tmp_path)
    (tmp_path / "a.gtf").write_text("\n".join(GENES))
    artifacts = spark.createDataFrame([("chr1", 1500, 2500, 5, 60, 60)], "chrom string, intron_start int, intron_end int, count int, max_anchor_left int, max_anchor_right int")
    artifacts.write.parquet(f"{d}/artifacts")
    cli.main(["index", "--gtf", f"{d}/a.gtf", "--out", f"{d}/index", *(["--artifacts", f"{d}/artifacts"] if more.get("artifacts") else [])], spark)
    t = spark.read.parquet(f"{d}/index/transcripts").withColumns({"abundance": F.lit(10.0), "nrna_abundance": F.lit(0.0)})
    sims = M.paired_records(M.fragments(t, spark.createDataFrame(REFS[:1], "ref string, length long"), 300, 0, 40, M.SimConfig(seed=4)))
    every = sims.unionByName(spark.createDataFrame(odd_rows(), N.ALIGNMENT_SCHEMA))
    bam.write_bam(bam.encoded(every.withColumn("own", F.monotonically_increasing_id()), REFS), bam.Header("@HD\tVN:1.6\tSO:queryname\n", REFS), f"{d}/in.bam", ["qname", "own"])
    return d


def by_name(records):
    out = {}
    for r in records:
        out.setdefault(r.qname, []).append(bam.tags(bytes(r.raw)))
    return out


def test_annotated_file_through_the_command_line(spark, tmp_path):
    d = prepared(spark, tmp_path, artifacts=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        cli.main(["quant", "--alignments", f"{d}/in.bam", "--index", f"{d}/index", "--out", f"{d}/out", "--annotated", f"{d}/annotated", "--assignment-mode", "map"], spark)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    before, after = (bam.read_records(spark, f"{d}/{x}").orderBy(*bam.KEY).collect() for x in ("in.bam", "annotated"))
    assert [tuple(r[c] for c in bam.COLUMNS) for r in before] == [tuple(r[c] for c in bam.COLUMNS) for r in after]
    cut = lambda r: bytes(r.raw)[: bam.tags_at(bytes(r.raw))]
    assert [cut(r) for r in before] == [cut(r) for r in after]
    for x, y in zip(before, after):
        own = bam.tags(bytes(x.raw))
        got = bam.tags(bytes(y.raw))
        assert {k: got[k] for k in own} == own
        assert set(got) - set(own) == (set() if x.qname.startswith("a_") else set(stamps.TAGS))
    tags = by_name(after)
    names = {r.t_id: (r.t_index, r.g_index) for r in spark.read.parquet(f"{d}/index/transcripts").collect()}
    single = [q for q in tags if q.startswith("t4:")]
    assert len(single) > 20
    for q in single:
        for t in tags[q]:
            # A transcript of one exon counts as nascent.
            assert (t["ZT"], t["ZG"], t["ZI"], t["ZJ"], t["ZF"], t["ZH"], t["ZB"]) == ("t4", "g3", *names["t4"], 9, 1, 0)
            assert t["ZW"] > 0.5 and t["ZC"] == "unambig" and t["ZS"] == "unspliced"
    for t in tags["d_outside"]:
        assert [t[k] for k in ("ZT", "ZG", "ZR", "ZI", "ZJ", "ZF", "ZW", "ZC", "ZH", "ZN", "ZS", "ZL")] == [".", ".", ".", -1, -1, 0x25, 1.0, ".", 1, 0, "unknown", -1]
    for t in tags["e_chimera"]:
        assert (t["ZF"], t["ZW"], t["ZC"], t["ZT"]) == (0x40, 0.0, ".", ".")
    for q in ("b_two", "c_loose"):
        assert {t["ZC"] for t in tags[q]} == {"multimapper"} and len({t["ZT"] for t in tags[q]}) == 1
        assert sorted(t["ZH"] for t in tags[q]) == [0, 0, 1, 1]
    assert [t["ZB"] for t in tags["f_bad"]] == [1, 0]
    counts = index_tables.read_text(spark, f"{d}/out/summary")["alignments"]
    n = len(before)
    assert [counts[k] for k in ("total", "qc_fail", "unmapped", "duplicate", "secondary")] == [n, 1, 1, 1, 4]
    assert counts["n_read_names"] == counts["n_fragments"] == counts["unique"] + 2 and counts["multimapping"] == 2


def test_without_multimappers(spark, tmp_path):
    d = prepared(spark, tmp_path)
    cli.main(["quant", "--alignments", f"{d}/in.bam", "--index", f"{d}/index", "--out", f"{d}/out", "--annotated", f"{d}/annotated", "--no-multimap"], spark)
    tags = by_name(bam.read_records(spark, f"{d}/annotated").collect())
    for q in ("b_two", "c_loose"):
        assert {(t["ZF"], t["ZW"], t["ZC"], t["ZH"], t["ZS"]) for t in tags[q]} == {(0x80, 0.0, ".", 1, "unknown")}


def test_tags_of_the_same_name_are_replaced(spark):
    refs = {"chr1": 0}
    raw = bam.encode(dict(zip(bam.COLUMNS, row("q", 99, 5))), refs) + bam.tag_bytes("ZT", "Z", "old") + bam.tag_bytes("ZQ", "i", 70000)
    records = spark.createDataFrame([("f", 0, 0, raw), ("f", 0, 1, raw)], "file string, at long, k long, raw binary")
    tags = spark.createDataFrame([("f", 0, 0, "new", -129)], "file string, at long, k long, name string, n int")
    got = {r.k: bam.tags(bytes(r.raw)) for r in bam.stamped(records, tags, {"ZT": ("Z", "name"), "ZI": ("i", "n")}).collect()}
    assert got[0] == {"NM": 0, "NH": 1, "ZQ": 70000, "ZT": "new", "ZI": -129}
    assert got[1] == {"NM": 0, "NH": 1, "ZT": "old", "ZQ": 70000}


def test_molecule_counts(spark):
    rows = [row("a", 99, 1), row("a", 147, 5), row("b", 97, 1), row("b", 145, 5), row("c", 99, 1), row("d", 99, 1, nh=3, hi=0), row("d", 147, 1, nh=3, hi=0), row("d", 99, 9, nh=3, hi=1), row("e", 99, 1), row("e", 147, 2), row("e", 99 | 0x100, 7), row("f", 99, 1), row("f", 99 | 0x800, 30), row("f", 147, 8)]
    df = spark.createDataFrame(rows, N.ALIGNMENT_SCHEMA)
    assert stamps.molecule_counts(df).first().asDict() == {"n_read_names": 6, "unique": 4, "multimapping": 2, "proper_pair": 3, "improper_pair": 1, "mate_unmapped": 2, "n_fragments": 6}
    assert stamps.molecule_counts(df, include_multimap=False).first().asDict() == {"n_read_names": 6, "unique": 4, "multimapping": 2, "proper_pair": 2, "improper_pair": 1, "mate_unmapped": 1, "n_fragments": 4}
    assert stamps.molecule_counts(df.limit(0)).first()["n_read_names"] == 0
    with pytest.raises(Exception, match="paired"):
        stamps.molecule_counts(spark.createDataFrame([row("a", 0, 1)], N.ALIGNMENT_SCHEMA)).collect()
