"""Command line, sources, sinks, pairing and streams, on small files."""

import datetime as dt
import json
import struct
import zlib

import pytest

from fraglens import cli
from fraglens.config import resolve
from fraglens.operators import pairing
from fraglens.sources import annotation as N
from fraglens.sources import bam, index_tables, results
from fraglens.streaming import molecules as M

from test_quantify import GENES


def test_command_line(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("\n".join(GENES))
    (tmp_path / "a.fai").write_text("chr1\t30000\t0\t60\t61\n")
    d = str(tmp_path)
    cli.main(["index", "--gtf", f"{d}/a.gtf", "--out", f"{d}/index", "--bed", "--references", f"{d}/a.fai", "--tsv"], spark)
    cli.main(["sim", "--index", f"{d}/index", "--references", f"{d}/a.fai", "--out", f"{d}/rows", "--mrna", "300", "--gdna", "50"], spark)
    rows = spark.read.parquet(f"{d}/rows")
    assert rows.count() == 700
    results.sam_lines(rows).coalesce(1).write.text(f"{d}/text")
    back = N.read_sam(spark, f"{d}/text")
    assert back.select(rows.columns).exceptAll(rows).count() == 0
    cli.main(["quant", "--alignments", f"{d}/rows", "--index", f"{d}/index", "--out", f"{d}/out", "--annotated", f"{d}/sam", "--assignment-mode", "map", "--seed", "3"], spark)
    summary = json.loads(spark.read.text(f"{d}/out/summary").first()[0])
    assert summary["fragments"]["n_fragments"] == 350 and summary["configuration"]["em"]["assignment_mode"] == "map"
    tagged = [r.value for r in spark.read.text(f"{d}/sam").collect()]
    assert len(tagged) == 700 and all("\tZC:Z:" in x and "\tZF:i:" in x for x in tagged)
    again = json.loads(spark.read.text(f"{d}/out/config").first()[0])
    assert again["assignment_mode"] == "map" and again["seed"] == 3 and resolve({}, again)[0] == resolve({"assignment_mode": "map", "seed": 3})[0]
    cli.main(["export", "--tables", f"{d}/out", "--out", f"{d}/tsv"], spark)
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{d}/tsv/quant").count() == 4


def test_index_tables(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("\n".join(GENES))
    t = cli.Q.index(N.read_gtf(spark, f"{tmp_path}/a.gtf"))
    junctions = spark.createDataFrame([("chr1", 5, 9, 3, 4, 2), ("chr1", 5, 9, 2, 7, 2), ("chr1", 6, 9, 1, 1, 1)], "chrom string, intron_start int, intron_end int, max_anchor_left int, max_anchor_right int, count int")
    d = f"{tmp_path}/index"
    written = index_tables.write_index(t, d, spark.createDataFrame([("chr1", 30000), ("chr2", 10)], "ref string, length long"), N.splice_blacklist(junctions), True)
    got = index_tables.read_index(spark, d)
    assert got.manifest == written and got.manifest["rows"]["transcripts"] == got.transcripts.count()
    assert [tuple(r) for r in got.blacklist.collect()] == [("chr1", 5, 9, 3, 7)]
    assert got.intervals.filter("interval_type = 2 AND ref = 'chr2'").count() == 1
    assert got.junctions.count() == got.transcripts.filter("NOT is_synthetic").selectExpr("sum(size(exons) - 1)").first()[0]
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{d}/text/transcripts").count() == got.transcripts.count()
    got.transcripts.filter("t_index > 0").write.parquet(f"{d}2/transcripts")
    with pytest.raises(ValueError, match="numbered"):
        index_tables.read_index(spark, f"{d}2")


def binary(rows, refs) -> bytes:
    """Rows of the alignment schema as binary records; blocks are cut within records."""
    out = b"BAM\x01" + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)
    at = {n: k for k, (n, _) in enumerate(refs)} | {"*": -1}
    for r in rows:
        ops = [(int(n) << 4) | bam.OPERATIONS.index(o) for n, o in __import__("re").findall(r"(\d+)([MIDNSHP=X])", r.cigar)]
        extra = b"NMC" + bytes([r.nm]) + b"NHi" + struct.pack("<i", r.nh) + (b"HIs" + struct.pack("<h", r.hi) if r.hi >= 0 else b"") + (b"XSA" + r.xs.encode() if r.xs else b"") + b"ZZZab\0ZBBS" + struct.pack("<iHH", 2, 1, 2)
        body = struct.pack("<iiBBHHHiiii", at[r.ref], r.pos, len(r.qname) + 1, r.mapq, 0, len(ops), r.flag, 3, at[r.mate_ref], r.mate_pos, 0) + r.qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + b"\x12\x40" + b"\xff" * 3 + extra
        out += struct.pack("<i", len(body)) + body
    blocks = b""
    for k in [*range(0, len(out), 1000), len(out)]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        piece = out[k : k + 1000]
        packed = z.compress(piece) + z.flush()
        blocks += b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(piece), len(piece))
    return blocks


def test_binary_alignments(spark, tmp_path):
    rows = [(f"q{k}", 99, "chr1", k, 60, "50M100N50M" if k % 2 else "3S97M", "chr2" if k % 3 else "*", k + 7, k % 4, 1 + k % 2, k % 3 - 1, "+" if k % 2 else None, None) for k in range(200)]
    df = spark.createDataFrame(rows, N.ALIGNMENT_SCHEMA)
    raw = binary(df.collect(), [("chr1", 30000), ("chr2", 10)])
    (tmp_path / "a.bam").write_bytes(raw)
    got = bam.read_bam(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert {tuple(r) for r in bam.bam_references(spark, str(tmp_path)).collect()} == {("chr1", 30000), ("chr2", 10)}
    with pytest.raises(ValueError, match="BGZF"):
        bam.read_header([b"SAM text"])


def test_numbering_of_hits(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("\n".join(GENES))
    t = cli.Q.index(N.read_gtf(spark, f"{tmp_path}/a.gtf"))
    row = lambda q, flag, pos, hi=-1: (q, flag, "chr1", pos, 60, "50M", "chr1", pos, 0, 2, hi, None, None)
    plain = [row("u", 99, 100), row("u", 147, 300), row("h", 99, 100, 0), row("h", 99 | 0x100, 25000, 1)]
    asking = [row("m", 99, 20000), row("m", 147, 20100), row("m", 99 | 0x100, 25000), row("m", 147 | 0x100, 25100), row("s", 99, 20000), row("s", 0x149, 25000)]
    df = lambda rows: spark.createDataFrame(rows, N.ALIGNMENT_SCHEMA)
    same = df(plain)
    assert pairing.number_hits(same, t) is same
    got = pairing.number_hits(df(plain + asking), t).collect()
    assert sorted((r.qname, r.flag, r.pos, r.hi) for r in got if r.qname in "uh") == sorted((q, f, p, h) for q, f, _, p, *_, h, _, _ in plain)
    hits = {}
    for r in got:
        hits.setdefault((r.qname, r.hi), []).append(r.pos)
    assert sorted(sorted(v) for (q, _), v in hits.items() if q == "m") == [[20000, 20100], [25000, 25100]]
    assert sorted(v for (q, _), v in hits.items() if q == "s") == [[20000], [25000]]


def test_abundance_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("Name\tLength\tEffectiveLength\tTPM\tNumReads\nt1\t100\t50\t10\t3\n")
    r = results.read_abundances(spark, str(tmp_path / "s.tsv")).first()
    assert (r.transcript_id, r["count"], r.effective_length) == ("t1", 3.0, 50.0)
    with pytest.raises(ValueError, match="unknown"):
        results.abundance_format(["a"])


def test_fastq_truth(spark, tmp_path):
    (tmp_path / "r.fq").write_text("".join(f"@{n}/1\nACGT\n+\n@@@@\n" for n in ("t1:0-9:f:1", "t1:0-9:f:2", "nrna_t1:0-9:r:1", "gdna:chr1:5-9:f:1")))
    got = {(r.pool, r.t_id): r.n for r in results.fastq_truth(spark, str(tmp_path / "r.fq")).collect()}
    assert got == {("mrna", "t1"): 2, ("nrna", "t1"): 1, ("gdna", None): 1}


def test_pairing(spark):
    schema = "qname string, i int, ref string, pos int, ts array<int>"
    a = spark.createDataFrame([("m", 0, "c1", 100, [1]), ("m", 1, "c1", 5000, []), ("m", 2, "c2", 7, []), ("s", 0, "c1", 1, [])], schema)
    b = spark.createDataFrame([("m", 0, "c1", 5100, []), ("m", 1, "c1", 300, [1, 2]), ("m", 2, "c3", 9, []), ("t", 4, "c1", 1, [])], schema)
    got = {(r.qname, r.first, r.second) for r in pairing.pair_hits(a, b).collect()}
    assert got == {("m", 0, 1), ("m", 1, 0), ("m", 2, 2), ("s", 0, None), ("t", None, 4)}


def test_stream_of_molecules(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    row = lambda n, hi, nh, minute: (n, 99, "chr1", 1, 60, "5M", "chr1", 1, 0, nh, hi, None, None, at + dt.timedelta(minutes=minute))
    schema = N.ALIGNMENT_SCHEMA + ", seen timestamp"
    for rows in ([row("a", 0, 2, 0), row("b", -1, 1, 1)], [row("a", 1, 2, 5)], [row("z", -1, 1, 60)], [row("y", -1, 1, 61)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    q = M.each_batch(M.molecules(M.read_alignments(spark, str(tmp_path / "in"), 1)), lambda df, k: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.qname: (r.n_records, r.n_hits, r.multimapping) for r in seen}
    assert got["a"] == (2, 2, True) and got["b"] == (1, 1, False)


def test_windows_of_a_table(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 9, 10, 25)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, value double")
    assert sorted(r.n for r in M.windowed(df, "ts", ["user_id"], "10 minutes").collect()) == [1, 1, 2]
    assert M.windowed(df, "ts", ["user_id"], "10 minutes", "5 minutes").agg({"n": "sum"}).first()[0] == 8
