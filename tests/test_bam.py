"""The splittable source and the sink of binary alignments."""

import random
import struct

import pyarrow as pa
import pytest

from fraglens.sources import annotation as N
from fraglens.sources import bam

REFS = [("chr1", 300_000), ("chr2", 10), ("é", 7)]


def alignment(k, rnd):
    cigar = rnd.choice(["100M", "3S97M", "40M1000N60M", "10M2I5D88M", "*"])
    return (f"q{k:06d}", rnd.choice([99, 147, 4, 0x400 | 99]), rnd.choice(["chr1", "chr2", "*"]), rnd.randint(-1, 200_000), rnd.randint(0, 254), cigar, "chr1", rnd.randint(-1, 9), rnd.choice([0, 3, 300, 70_000]), rnd.randint(1, 9), rnd.choice([-1, 0, 5]), rnd.choice([None, "+", "-"]), None)


def raws(n, seed=0, long=False):
    """Records with sequences, qualities and tags of all types."""
    rnd = random.Random(seed)
    refs = {r: i for i, (r, _) in enumerate(REFS)}
    out = []
    for k in range(n):
        row = dict(zip(bam.COLUMNS, alignment(k, rnd)))
        m = rnd.randint(0, 3000 if long and k % 40 == 0 else 120)
        row |= {"seq": "".join(rnd.choice("ACGTN") for _ in range(m)), "qual": "".join(chr(33 + rnd.randint(0, 60)) for _ in range(m))}
        extra = b"ZZZab\0ZBBS" + struct.pack("<iHH", 2, 1, 2) + b"ZHH1AFF\0" + b"Zcc" + struct.pack("<b", -5) + b"Zff" + struct.pack("<f", 0.5) + b"ZMZ" + bam.MAGIC + b"\0"
        out.append(bam.encode(row, refs) + extra)
    return out


def file_of(records, block=700, level=6, text="@HD\tVN:1.6\n"):
    """One file; blocks are cut within records, some are stored as they are, so that the first bytes of blocks occur in them."""
    data = bam.Header(text, REFS).data() + b"".join(struct.pack("<i", len(r)) + r for r in records)
    return b"".join(bam.deflate(data[at : at + block], 0 if at // block % 3 == 0 else level) for at in range(0, len(data), block)) + bam.END


def read(spark, path, split=None):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split or 128 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split else "4194304")
    try:
        rows = bam.read_records(spark, path)
        n = bam.pieces(spark, path).rdd.getNumPartitions()
        return [bytes(r.raw) for r in rows.orderBy(*bam.KEY).collect()], n, rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split,block,text", [(None, 700, "@HD\n"), (20_000, 700, "@HD\n"), (3_000, 300, "@HD\n"), (2_500, 65_000, "@HD\n"), (4_000, 900, "@CO\t" + "".join(chr(97 + i * i % 26) for i in range(30_000)))])
def test_every_record_once_and_in_order(spark, tmp_path, split, block, text):
    records = raws(900, long=True)
    (tmp_path / "a.bam").write_bytes(file_of(records, block, text=text))
    got, n, rows = read(spark, str(tmp_path), split)
    assert got == records
    assert n > 8 or not split
    want = [bam.record(r, [x for x, _ in REFS]) for r in records]
    assert sorted(map(tuple, bam.read_bam(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_first_bytes_of_blocks_in_data_by_chance(spark, tmp_path):
    """A stored block that is full of them, cut anywhere."""
    refs = {r: i for i, (r, _) in enumerate(REFS)}
    row = dict(zip(bam.COLUMNS, alignment(1, random.Random(3))))
    records = [bam.encode(row | {"qname": f"n{k}"}, refs) + b"ZZB" + b"C" + struct.pack("<i", 400) + bam.MAGIC * 100 for k in range(60)]
    (tmp_path / "a.bam").write_bytes(file_of(records, 5000, level=0))
    for split in (None, 1500, 900):
        assert read(spark, str(tmp_path), split)[0] == records


def test_folders_and_empty_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bam").write_bytes(file_of(raws(50 * i, i)))
    (tmp_path / "notes.txt").write_text("none")
    got, _, rows = read(spark, str(tmp_path), 4000)
    assert got == [r for i in range(3) for r in raws(50 * i, i)]
    assert {tuple(r) for r in bam.bam_references(spark, str(tmp_path)).collect()} == set(REFS)


@pytest.mark.parametrize("damage", ["cut", "byte", "text", "tail", "plain"])
def test_damaged_files(spark, tmp_path, damage):
    raw = file_of(raws(300), 900)
    at = len(raw) // 2
    bad = {"cut": raw[: at + 5], "byte": raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :], "text": b"SAM text", "tail": raw[:-20], "plain": bam.deflate(b"other data" * 100) + bam.END}[damage]
    (tmp_path / "a.bam").write_bytes(bad)
    with pytest.raises(Exception, match="cut short|damaged|not a file|no records|do not meet|invalid|incorrect|Error"):
        read(spark, str(tmp_path), 5000)


def test_written_files(spark, tmp_path):
    records = raws(2000, 5, long=True)
    rnd = random.Random(1)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "k long, raw binary").orderBy(F_rand(rnd)).repartition(5)
    header = bam.Header("@HD\tVN:1.6\n", REFS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    bam.write_bam(df, header, f"{tmp_path}/out", ["k"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("*.bam"))
    assert len(files) > 1
    got = []
    for f in files:
        raw = f.read_bytes()
        assert raw.endswith(bam.END)
        data = b""
        while raw:
            n = bam.block_size(raw)
            data, raw = data + bam.inflate(raw[:n]), raw[n:]
        head, at = bam.parse_header(data)
        assert (head.text, head.references) == (header.text, REFS)
        while at < len(data):
            n = struct.unpack_from("<i", data, at)[0]
            got.append(data[at + 4 : at + 4 + n])
            at += 4 + n
    assert got == records
    assert read(spark, f"{tmp_path}/out", 9000)[0] == records
    bam.write_bam(df.limit(0), header, f"{tmp_path}/none", ["k"])
    assert read(spark, f"{tmp_path}/none")[0] == []


def F_rand(rnd):
    from pyspark.sql import functions as F

    return F.rand(rnd.randint(0, 99))


def test_encoding_of_rows(spark):
    rnd = random.Random(2)
    rows = [alignment(k, rnd) for k in range(200)]
    got = bam.encoded(spark.createDataFrame(rows, N.ALIGNMENT_SCHEMA), REFS).collect()
    back = [bam.record(bytes(r.raw), [x for x, _ in REFS]) for r in got]
    assert sorted(back, key=str) == sorted(rows, key=str)
    assert bam.sequence(raws(1)[0])[0].strip("ACGTN") == ""
    assert bam.reg2bin(0, 1) == 4681 and bam.reg2bin(0, 1 << 29) == 0 and bam.reg2bin((1 << 14) - 1, (1 << 14) + 1) == 585


def test_records_are_made_once(spark, tmp_path):
    """Ranges of the order come from a sample; what makes the records does not run for that as well."""
    made = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(f"q{k}", k) for k in range(500)], "qname string, k int").repartition(3)
    row = {"flag": 1, "ref": "c", "pos": 5, "mapq": 9, "cigar": "10M", "mate_ref": "*", "mate_pos": -1}

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            raws = [bam.encode(row | {"qname": q}, {"c": 0}) for q in batch.column("qname").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(raws, pa.binary())], names=["k", "raw"])

    bam.write_bam(rows.mapInArrow(run, "k int, raw binary"), bam.Header("", [("c", 1000)]), f"{tmp_path}/x", ["k"])
    assert made.value == 500
    assert [r.qname for r in bam.read_bam(spark, f"{tmp_path}/x").collect()] and bam.read_bam(spark, f"{tmp_path}/x").count() == 500
