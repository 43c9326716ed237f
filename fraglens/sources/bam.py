"""Binary alignments (BGZF blocks of binary records) as a splittable source and a sink, by the published format.

Spark's text reader cuts a file at the first four bytes of a block, so that a file of any size is dealt out in splits by
Spark itself, from any file system that it reads, and a block is a row. Compressed data may hold those bytes by chance:
such pieces are put together again by the size that each block states. A split does not know where its first record
begins; it is found as the first place from which plausible records follow one another, and proved right afterwards:
what a split leaves over at its end and the next one has before its first record must be whole records. The rows are
written once, as Parquet in the shared checkpoint folder, with the key (file, at, k): file, start of the split, number
in it, which is the order of the file. Records that lie across splits are put together there, a few bytes a split.

The sink deals records out by ranges of an order and packs them into blocks; a part is a whole file, with header and end
marker, since the text writer puts the empty block, which is that marker, behind every row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import cut, shared_folder
from .annotation import ALIGNMENT_SCHEMA

# The first bytes of a block, the empty block that ends a file, operations of the binary CIGAR, letters of packed bases, and struct codes of the types of tags.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BATCH = 20_000
#: Bytes of data in a block that is written, and of blocks in a row for the text writer.
BLOCK, ROW = 65_280, 1 << 20
#: Consecutive plausible records that make a start.
CHAIN = 12
COLUMNS = [c.split(" ")[0] for c in ALIGNMENT_SCHEMA.split(", ")]
KEY = ["file", "at", "k"]
_EDGE = ["comp_head", "head", "tail", "comp_tail"]
SCHEMA = f"file string, at long, k long, n long, through boolean, raw binary, {', '.join(f'{c} binary' for c in _EDGE)}, {ALIGNMENT_SCHEMA}"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])


# -- blocks -----------------------------------------------------------------


def block_size(raw: bytes) -> int:
    """The size that a block states in its extra field; 0 if this is the beginning of no block."""
    if len(raw) < 18 or raw[:4] != MAGIC:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", raw, 10)[0]
    while at + 4 <= min(end, len(raw)):
        n = struct.unpack_from("<H", raw, at + 2)[0]
        if raw[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(raw):
            return struct.unpack_from("<H", raw, at + 4)[0] + 1
        at += 4 + n
    return 0


def inflate(block: bytes) -> bytes:
    """The data of a block, checked."""
    extra = struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[12 + extra : -8], -15)
    if (zlib.crc32(data), len(data)) != struct.unpack("<II", block[-8:]):
        raise ValueError("a BGZF block is damaged")
    return data


def deflate(data: bytes, level: int = 6) -> bytes:
    """Blocks of the data."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        packed = c.compress(part) + c.flush()
        if len(packed) + 26 > 1 << 16:
            c = zlib.compressobj(0, zlib.DEFLATED, -15)
            packed = c.compress(part) + c.flush()
        out.append(END[:16] + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


# -- records ----------------------------------------------------------------


def tag_spans(raw: bytes, at: int) -> Iterator[tuple[str, str, int, int]]:
    """(name, kind, first byte of the value, end) of each tag."""
    while at < len(raw):
        name, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind == "A":
            end = at + 1
        elif kind in NUMBERS:
            end = at + struct.calcsize("<" + NUMBERS[kind])
        elif kind in "ZH":
            end = raw.index(b"\0", at) + 1
        elif kind == "B":
            end = at + 5 + struct.unpack_from("<i", raw, at + 1)[0] * struct.calcsize("<" + NUMBERS[chr(raw[at])])
        else:
            raise ValueError(f"unknown type of tag: {kind}")
        yield name, kind, at, end
        at = end


def tags_at(raw: bytes) -> int:
    """Where the tags of a record begin."""
    n_name, n_cigar, n_seq = raw[8], *struct.unpack_from("<H", raw, 12), *struct.unpack_from("<i", raw, 16)
    return 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq


def tags(raw: bytes) -> dict:
    """Values by name."""
    return dict(_tags(raw[tags_at(raw) :]))


@lru_cache(1 << 14)
def _tags(raw: bytes) -> dict:
    """Values by name of the tags of a record; neighbouring records often have the same ones."""
    out = {}
    for name, kind, at, end in tag_spans(raw, 0):
        if kind == "A":
            out[name] = chr(raw[at])
        elif kind in "ZH":
            out[name] = raw[at : end - 1].decode(errors="replace")
        elif kind == "B":
            out[name] = struct.unpack_from(f"<{struct.unpack_from('<i', raw, at + 1)[0]}{NUMBERS[chr(raw[at])]}", raw, at + 5)
        else:
            out[name] = struct.unpack_from("<" + NUMBERS[kind], raw, at)[0]
    return out


@lru_cache(1 << 14)
def _spelled(ops: tuple[int, ...]) -> str:
    return "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*"


def record(raw: bytes, refs: list[str]) -> tuple:
    """A row of the alignment schema; NM defaults to 0, NH to 1, HI to -1."""
    ref, pos, n_name, mapq, _, n_cigar, flag, _, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", raw)
    name = raw[32 : 31 + n_name].decode()
    t = _tags(raw[tags_at(raw) :])
    cigar = _spelled(t.get("CG", struct.unpack_from(f"<{n_cigar}I", raw, 32 + n_name)))
    place = lambda k: refs[k] if k >= 0 else "*"
    text = lambda x: x if isinstance(x, str) else None
    return name, flag, place(ref), pos, mapq, cigar, place(mate), mate_pos, t.get("NM", 0), t.get("NH", 1), t.get("HI", -1), text(t.get("XS")), text(t.get("ts"))


def reg2bin(start: int, end: int) -> int:
    """The number of the smallest bin of the published scheme that holds [start, end)."""
    end -= 1
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def number(x: int) -> tuple[str, bytes]:
    """The shortest type of tag that holds a whole number."""
    for kind in "cs" if x < 0 else "CSI":
        code = NUMBERS[kind]
        n = struct.calcsize(code) * 8
        if -(1 << n - 1) <= x < 0 if x < 0 else x < 1 << n:
            return kind, struct.pack("<" + code, x)
    return "i", struct.pack("<i", x)


def tag_bytes(name: str, kind: str, value) -> bytes:
    """``kind`` is that of text: A, Z, i or f."""
    if kind == "i":
        kind, packed = number(int(value))
    else:
        packed = struct.pack("<f", value) if kind == "f" else str(value).encode() + (b"\0" if kind == "Z" else b"")
    return name.encode() + kind.encode() + packed


_tag_bytes = lru_cache(1 << 14, typed=True)(tag_bytes)


@lru_cache(1 << 14)
def _operations(cigar: str) -> tuple[int, bytes, int]:
    """(number, packed operations, bases of the reference, 1 at least)."""
    ops = [(int(n), OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return len(ops), struct.pack(f"<{len(ops)}I", *(n << 4 | o for n, o in ops)), sum(n for n, o in ops if o in (0, 2, 3, 7, 8)) or 1


def encode(row: dict, refs: dict[str, int]) -> bytes:
    """A record of an alignment row; ``seq`` and ``qual`` (Phred + 33) may be missing or ``*``."""
    n_ops, ops, span = _operations(row["cigar"] or "")
    seq, qual = (row.get(c) or "*" for c in ("seq", "qual"))
    seq = "" if seq == "*" else seq
    codes = [BASES.index(b) if b in BASES else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    name = (row["qname"] or "*").encode() + b"\0"
    pos = row["pos"]
    head = struct.pack("<iiBBHHHiiii", refs.get(row["ref"], -1), pos, len(name), row["mapq"], reg2bin(pos, pos + span) if pos >= 0 else 4680, n_ops, row["flag"], len(seq), refs.get(row["mate_ref"], -1), row["mate_pos"], 0)
    out = [head, name, ops, bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])), b"\xff" * len(seq) if qual == "*" else bytes(ord(q) - 33 for q in qual)]
    for tag, kind, c in (("NM", "i", "nm"), ("NH", "i", "nh"), ("HI", "i", "hi"), ("XS", "A", "xs"), ("ts", "A", "ts")):
        if row.get(c) is not None and not (c == "hi" and row[c] < 0):
            out.append(_tag_bytes(tag, kind, row[c]))
    return b"".join(out)


def sequence(raw: bytes) -> tuple[str, str]:
    """Bases and qualities of a record."""
    n = struct.unpack_from("<i", raw, 16)[0]
    end = tags_at(raw)
    packed, qual = raw[end - n - (n + 1) // 2 : end - n], raw[end - n : end]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n]
    return seq or "*", "*" if not n or qual[0] == 255 else "".join(chr(q + 33) for q in qual)


# -- headers ----------------------------------------------------------------


@dataclass
class Header:
    text: str = ""
    references: list[tuple[str, int]] = field(default_factory=list)
    #: SHA-256 of the blocks that hold nothing but the header; of the block with the first record, and where that begins in it.
    blocks: frozenset[bytes] = frozenset()
    first: bytes = b""
    skip: int = 0

    def data(self) -> bytes:
        text = self.text.encode()
        refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in self.references)
        return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.references)) + refs


def parse_header(data: bytes) -> tuple[Header, int] | None:
    """The header and its size; None if more data is needed."""
    if len(data) >= 4 and data[:4] != b"BAM\x01":
        raise ValueError("not a file of binary alignments")
    try:
        n = struct.unpack_from("<i", data, 4)[0]
        text, at = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
        refs = []
        for _ in range(struct.unpack_from("<i", data, at)[0]):
            k = struct.unpack_from("<i", data, at + 4)[0]
            refs.append((data[at + 8 : at + 7 + k].decode(), struct.unpack_from("<i", data, at + 8 + k)[0]))
            at += 8 + k
        return Header(text, refs), at + 4
    except struct.error:
        return None


def read_header(first_bytes: Iterable[bytes]) -> Header:
    """From longer and longer beginnings of a file, the last being the whole."""
    for raw in first_bytes:
        at, data, own = 0, b"", []
        while (n := block_size(raw[at : at + (1 << 16)])) and at + n <= len(raw):
            own.append(raw[at : at + n])
            data += inflate(own[-1])
            at += n
            got = parse_header(data)
            if got and len(data) > got[1]:
                header, size = got
                header.blocks, header.first = frozenset(hashlib.sha256(b).digest() for b in own[:-1]), hashlib.sha256(own[-1]).digest()
                header.skip = size - (len(data) - len(inflate(own[-1])))
                return header
    if raw and not block_size(raw[: 1 << 16]):
        raise ValueError("not a file of BGZF blocks")
    if at < len(raw) or not (got := parse_header(data)):
        raise ValueError("a BGZF block is cut short" if at < len(raw) else "alignments are cut short")
    got[0].blocks = frozenset(hashlib.sha256(b).digest() for b in own)
    return got[0]


def headers(spark: SparkSession, path: str) -> dict[str, Header]:
    """By file. Only the beginnings of files are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("_metadata.file_path", "path", "length")

    def beginnings(file: str, length: int) -> Iterator[bytes]:
        where, n = jvm.org.apache.hadoop.fs.Path(file), 1 << 17
        while True:
            stream = where.getFileSystem(conf).open(where)
            try:
                yield bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, length)))
            finally:
                stream.close()
            if n >= length:
                return
            n *= 8

    return {f.file_path: read_header(beginnings(f.path, f.length)) for f in files.collect()}


def bam_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref, length) of the headers, each once."""
    every = dict.fromkeys(r for h in headers(spark, path).values() for r in h.references)
    return spark.createDataFrame([*every], "ref string, length long")


# -- source -----------------------------------------------------------------


def plausible(buf: bytes, at: int, n_refs: int) -> int:
    """The end of what may be a record at ``at``, beyond the buffer if it is longer or cannot be told yet; 0 if it can be none."""
    if at + 36 > len(buf):
        return len(buf) + 1
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", buf, at)
    if size < 32 or not n_name or n_seq < 0 or not -1 <= ref < n_refs or not -1 <= mate < n_refs or pos < -1 or mate_pos < -1:
        return 0
    if 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return 0
    name = buf[at + 36 : at + 36 + n_name]
    if any(not 33 <= c <= 126 for c in name[: n_name - 1]) or (len(name) == n_name and name[-1]):
        return 0
    end = at + 4 + size
    if end <= len(buf):
        try:
            raw = buf[at + 4 : end]
            if any(e > size or not (t[:1].isalpha() and t[1:].isalnum()) for t, _, _, e in tag_spans(raw, tags_at(raw))):
                return 0
        except (ValueError, KeyError, IndexError, struct.error):
            return 0
    return end


def first_record(buf: bytes, n_refs: int, last: bool) -> int | None:
    """The first place from which plausible records follow one another, the first one whole: CHAIN of them, or as far as the data goes if that is the last. None: more data is needed, or no record begins here."""
    for start in range(len(buf) - 35):
        at, n = start, 0
        while n < CHAIN and at < len(buf):
            end = plausible(buf, at, n_refs)
            if not end or (end > len(buf) and not n):
                break
            at, n = end, n + 1
        else:
            if n >= CHAIN or last:
                return start
    return None


class _Split:
    """Records of one split, out of its pieces in order."""

    def __init__(self, file: str, at: int, header: Header):
        self.file, self.at, self.header = file, at, header
        self.refs = [n for n, _ in header.references]
        self.comp_head, self.head, self.cur = b"", b"", b""
        self.buf, self.k, self.known, self.any = b"", 0, False, False

    def take(self, piece: bytes) -> list[bytes]:
        """Whole records that the piece completes."""
        if not piece and self.at == 0 and not self.any:
            return []  # what stands before the first block
        block = MAGIC + piece
        if self.cur:
            self.cur += block
        elif block_size(block):
            self.any, self.cur = True, block
        elif not self.any:
            self.comp_head += block
            return []
        else:
            raise ValueError("not a file of BGZF blocks")
        want = block_size(self.cur)
        if len(self.cur) > want:
            raise ValueError("a BGZF block is cut short, or not a file of BGZF blocks")
        if len(self.cur) < want:
            return []
        block, self.cur = self.cur, b""
        return self.records(block)

    def records(self, block: bytes) -> list[bytes]:
        digest = hashlib.sha256(block).digest() if not self.k and not self.known else None
        if digest in self.header.blocks:
            self.known = not self.header.first  # a file without records
            return []
        self.buf += inflate(block)
        if digest == self.header.first:
            self.buf, self.known = self.buf[len(self.buf) - len(inflate(block)) + self.header.skip :], True
        return self.whole(False)

    def whole(self, last: bool) -> list[bytes]:
        if not self.known:
            start = first_record(self.buf, len(self.refs), last)
            if start is None:
                return []
            self.head, self.buf, self.known = self.buf[:start], self.buf[start:], True
        out, at = [], 0
        while at + 4 <= len(self.buf):
            size = struct.unpack_from("<i", self.buf, at)[0]
            if size < 32:
                raise ValueError("alignments are no records")
            if at + 4 + size > len(self.buf):
                break
            out.append(self.buf[at + 4 : at + 4 + size])
            at += 4 + size
        self.buf = self.buf[at:]
        return out

    def rows(self, records: list[bytes]) -> list[dict]:
        out = []
        for raw in records:
            out.append({"file": self.file, "at": self.at, "k": self.k, "raw": raw, **dict(zip(COLUMNS, record(raw, self.refs), strict=True))})
            self.k += 1
        return out

    def edge(self) -> dict:
        """What is left over. Without a start in it, all data is."""
        return {"file": self.file, "at": self.at, "n": self.k, "through": not self.known, "comp_head": self.comp_head, "head": self.head, "tail": self.buf, "comp_tail": self.cur}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def _reader(known: dict[str, Header]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows = None, []

        def close() -> None:
            if split:
                rows.extend(split.rows(split.whole(True)))
                rows.append(split.edge())

        for batch in batches:
            for file, at, piece in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("piece")):
                if split is None or (file, at) != (split.file, split.at):
                    close()
                    split = _Split(file, at, known[file])
                rows.extend(split.rows(split.take(piece.as_py())))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        close()
        if rows:
            yield _batch(rows)

    return run


def _across(known: dict[str, Header]):
    """Records that lie across splits of a file; an error if what is left over is not whole records."""

    def run(table: pa.Table) -> pa.Table:
        rows, held, key = [], b"", None
        comp = b""
        for e in sorted(table.to_pylist(), key=lambda e: e["at"]):
            header = known[e["file"]]
            refs = [n for n, _ in header.references]
            comp += e["comp_head"]
            if e["n"] or e["head"] or e["tail"] or e["comp_tail"] or not e["through"]:
                held += _inflated(comp, header)
                comp = b""
            held += e["head"] + (e["tail"] if e["through"] else b"")
            at = 0
            while at + 4 <= len(held) and at + 4 + (size := struct.unpack_from("<i", held, at)[0]) <= len(held):
                if key is None or size < 32:
                    raise ValueError("alignments are no records")
                raw = held[at + 4 : at + 4 + size]
                rows.append({"file": e["file"], "at": key[0], "k": key[1], "raw": raw, **dict(zip(COLUMNS, record(raw, refs), strict=True))})
                key, at = (key[0], key[1] + 1), at + 4 + size
            held = held[at:]
            if not e["through"]:
                if held:
                    raise ValueError("records of neighbouring splits do not meet")
                held, key = e["tail"], (e["at"], e["n"])
            elif key is None:
                key = (e["at"], 0)
            comp += e["comp_tail"]
        held += _inflated(comp, header) if comp else b""
        while len(held) >= 4 and 4 + (size := struct.unpack_from("<i", held)[0]) <= len(held):
            raw = held[4 : 4 + size]
            rows.append({"file": e["file"], "at": key[0], "k": key[1], "raw": raw, **dict(zip(COLUMNS, record(raw, refs), strict=True))})
            key, held = (key[0], key[1] + 1), held[4 + size :]
        if held:
            raise ValueError("alignments are cut short")
        return pa.Table.from_pylist(rows, _ARROW)

    return run


def _inflated(comp: bytes, header: Header) -> bytes:
    """Data of blocks that were cut by chance, without the header."""
    out = b""
    while comp:
        n = block_size(comp)
        if not n or n > len(comp):
            raise ValueError("a BGZF block is cut short")
        block, comp = comp[:n], comp[n:]
        digest = hashlib.sha256(block).digest()
        if digest not in header.blocks:
            out += inflate(block)[header.skip if digest == header.first else 0 :]
    return out


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, piece): what stands between the first bytes of blocks, with the start of the split."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("pathGlobFilter", "*.bam").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("piece"))


def read_records(spark: SparkSession, path: str, known: dict[str, Header] | None = None) -> DataFrame:
    """(file, at, k, raw) and alignment columns of a file or a folder of files, every record once; staged in the shared checkpoint folder."""
    known = known or headers(spark, path)
    stage = f"{shared_folder(spark)}/alignments-{uuid.uuid4().hex}"
    pieces(spark, path).mapInArrow(_reader(known), SCHEMA).write.parquet(stage)
    rows = spark.read.parquet(stage)
    across = rows.filter("k IS NULL").groupBy("file").applyInArrow(_across(known), SCHEMA)
    wanted = [*KEY, "raw", *COLUMNS]
    return rows.filter("k IS NOT NULL").select(*wanted).unionByName(across.select(*wanted))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of a file or a folder of files."""
    return read_records(spark, path).select(*COLUMNS)


# -- sink -------------------------------------------------------------------


def encoded(alignments: DataFrame, references: list[tuple[str, int]]) -> DataFrame:
    """Adds ``raw``, the binary record of an alignment row."""
    refs = {n: i for i, (n, _) in enumerate(references)}
    schema = alignments.withColumn("raw", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encode(r, refs) for r in batch.to_pylist()], pa.binary())], names=[*batch.schema.names, "raw"])

    return alignments.mapInArrow(run, schema)


def write_bam(records: DataFrame, header: Header, path: str, order: list[str]) -> None:
    """A folder of files, part-00000.bam and so on, each whole; one after the other they hold the records (column ``raw``) in the order.

    The records are made once, in the checkpoint folder: the order's ranges are found from a sample, a pass over all rows before the one that writes.
    The number of ranges is given, since Spark would join small ones by their bytes, and most of the time goes into compression.
    """
    spark, head = records.sparkSession, header.data()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [head], len(head)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([deflate(b"".join(held))], pa.binary())], names=["value"])
        for batch in batches:
            for b in batch.column("raw").to_pylist():
                held += [struct.pack("<i", len(b)), b]
                size += 4 + len(b)
                if size >= ROW:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = cut(records.select(*order, "raw")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("raw")
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).text(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if found := re.match(r"(part-\d+)", name):
            fs.rename(entry.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{found[1]}.bam"))


def stamped(records: DataFrame, tags: DataFrame, kinds: dict[str, tuple[str, str]], key: list[str] = KEY) -> DataFrame:
    """The records (``key``, raw), with tags of those that have a row in ``tags`` (``key`` and the columns that ``kinds`` names by tag, with their types) in the place of any of the same name; the others as they are."""
    columns = [c for _, c in kinds.values()]
    joined = records.select(*key, "raw").join(tags.select(*key, *columns, F.lit(True).alias("_has")), key, "left")
    schema = records.select(*key, "raw").schema

    def put(raw: bytes, row: dict) -> bytes:
        at = tags_at(raw)
        own = b"".join(raw[start - 3 : end] for name, _, start, end in tag_spans(raw, at) if name not in kinds)
        return raw[:at] + own + b"".join(tag_bytes(name, kind, row[c]) for name, (kind, c) in kinds.items() if row[c] is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [put(r["raw"], r) if r["_has"] else r["raw"] for r in batch.select(["raw", "_has", *columns]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(got, pa.binary())], names=[*key, "raw"])

    return joined.mapInArrow(run, schema)
