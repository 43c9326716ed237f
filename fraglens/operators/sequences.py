"""Reference sequences as a table of chunks, and what is cut out of them: blocks, spliced sequences, reads.

A reference of any length is rows (ref, chunk, sequence) of CHUNK bases each, the last one shorter. Blocks meet the one
or few chunks that they lie in by an equality join, so that no task ever holds a chromosome, and a chunk in which a
third of all blocks lie is split by the skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from .common import cut, running_sum

CHUNK = 8000
WIDTH = 80


# -- chunks -----------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Chunks of FASTA text, a file or a folder of files, upper-cased.

    Lines are read as Spark splits the text. A split joins its lines to runs without knowing where they lie in their
    record; what the splits before it hold of the record is added from their sums, a row for each header and split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.trim("value").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "at", "k", "name", "offset", "sequence"]
        state, k, name, offset, held, n = None, 0, None, 0, [], 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal offset, held, n
            if state and (held or name is not None and not offset):
                out.append((*state, k, name, offset, "".join(held)))
            offset, held, n = offset + n, [], 0

        for batch in batches:
            for file, at, value in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("value").to_pylist()):
                if (file, at) != state:
                    flush()
                    state, k, name, offset = (file, at), 0, None, 0
                if value.startswith(">"):
                    flush()
                    k, name, offset = k + 1, (value[1:].split() or [""])[0], 0
                elif value:
                    held.append(value.upper())
                    n += len(value)
                    if n >= 1 << 16:
                        flush()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if c else pa.array([], pa.string()) for c in zip(*out)], schema=_RUNS)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RUNS)], schema=_RUNS)
        del names

    runs = cut(lines.mapInArrow(run, "file string, at long, k int, name string, offset long, sequence string"))
    # A row for each split and record in it; of the first, without a name, the record goes on from a split before.
    parts = runs.groupBy("file", "at", "k").agg(F.max("name").alias("name"), F.sum(F.length("sequence")).alias("n"), F.max(F.lit(1)).alias("one"))
    parts = running_sum(parts.withColumn("head", F.col("name").isNotNull().cast("long")), ["file", "at", "k"], "head", "record")
    parts = running_sum(parts, ["file", "at", "k"], "n", "upto").withColumn("before", F.col("upto") - F.col("n"))
    firsts = parts.filter("name IS NOT NULL").select("record", F.col("name").alias("ref"), F.col("before").alias("begins"))
    placed = runs.join(parts.select("file", "at", "k", "record", "before"), ["file", "at", "k"]).join(firsts, "record")
    placed = placed.select("ref", (F.col("before") - F.col("begins") + F.col("offset")).alias("start"), "sequence")
    return chunked(placed, size)


_RUNS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("k", pa.int32()), ("name", pa.string()), ("offset", pa.int64()), ("sequence", pa.string())])


def chunked(runs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(ref, chunk, sequence) of runs (ref, start, sequence) that lie side by side."""
    end = F.col("start") + F.length("sequence")
    each = runs.filter("sequence <> ''").withColumn("end", end).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    low = F.greatest("start", F.col("chunk") * size)
    piece = F.substring("sequence", (low - F.col("start") + 1).cast("int"), (F.least("end", (F.col("chunk") + 1) * size) - low).cast("int"))
    got = each.select("ref", "chunk", F.struct(low.alias("start"), piece.alias("piece")).alias("p")).groupBy("ref", "chunk").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return got.select("ref", "chunk", F.array_join(F.transform("ps", lambda p: p.piece), "").alias("sequence"))


def random_chunks(references: DataFrame, seed: int, size: int = CHUNK, gc: float = 0.5) -> DataFrame:
    """Random bases for references (ref, length), a share ``gc`` of them G or C; a base depends on the seed and its place only."""
    chunks = references.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size)))).withColumn("n", F.least(F.lit(size), F.col("length") - F.col("chunk") * size).cast("int"))
    draw = lambda i: F.xxhash64(F.lit(seed), F.lit("base"), "ref", F.col("chunk") * size + i).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    base = lambda i: F.transform(F.array(draw(i)), lambda u: F.when(u < gc / 2, "G").when(u < gc, "C").when(u < gc + (1 - gc) / 2, "A").otherwise("T"))[0]
    return chunks.repartition("ref", "chunk").select("ref", "chunk", F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), base), "").alias("sequence"))


def edited(chunks: DataFrame, edits: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks with bases written over: edits (ref, pos, bases), later ids (``i``) over earlier ones; raises where they leave their reference."""
    length = chunks.groupBy("ref").agg(F.max(F.col("chunk") * size + F.length("sequence")).alias("length"))
    off = (F.col("pos") < 0) | (F.col("pos") + F.length("bases") > F.coalesce("length", F.lit(0)))
    e = edits.join(length, "ref", "left").withColumn("pos", F.when(off, F.raise_error(F.concat(F.lit("edit beyond its reference: "), "ref", F.lit(":"), F.col("pos").cast("string"))).cast("long")).otherwise(F.col("pos")))
    base = e.select("ref", "i", F.posexplode(F.split("bases", "")).alias("at", "base"), "pos").filter("base <> ''")
    base = base.groupBy("ref", (F.col("pos") + F.col("at")).alias("pos")).agg(F.max_by("base", "i").alias("base"))
    per = base.groupBy("ref", F.floor(F.col("pos") / size).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") % size + 1).cast("int").alias("i"), "base"))).alias("m"))
    put = F.array_join(F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.coalesce(F.element_at("m", i), F.substring("sequence", i, F.lit(1)))), "")
    return chunks.join(per, ["ref", "chunk"], "left").select("ref", "chunk", F.when(F.col("m").isNull(), F.col("sequence")).otherwise(put).alias("sequence"))


def splice_motifs(transcripts: DataFrame) -> DataFrame:
    """Edits (ref, pos, bases, i) that give every intron the motif of its strand: GT and AG at its ends, CT and AC on the minus strand."""
    t = transcripts.filter(F.size("exons") > 1).select("ref", "t_id", "strand", F.explode(F.expr("transform(sequence(1, size(exons) - 1), i -> named_struct('s', exons[i - 1].end, 'e', exons[i].start))")).alias("j")).filter("j.e - j.s >= 4")
    minus = F.col("strand") == S.NEG
    left, right = F.when(minus, "CT").otherwise("GT"), F.when(minus, "AC").otherwise("AG")
    i = F.struct("t_id", "j.s")
    return t.select("ref", F.col("j.s").cast("long").alias("pos"), left.alias("bases"), i.alias("i")).unionByName(t.select("ref", (F.col("j.e") - 2).cast("long").alias("pos"), right.alias("bases"), i.alias("i")))


def fasta_lines(chunks: DataFrame, size: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """(ref, chunk, value): FASTA text of each chunk, in lines of ``width`` bases, of which ``size`` is a multiple; the first has the header."""
    if size % width:
        raise ValueError("chunks must be whole lines")
    lines = F.expr(f"array_join(transform(sequence(0, (length(sequence) - 1) div {width}), i -> substring(sequence, i * {width} + 1, {width})), '\\n')")
    return chunks.select("ref", "chunk", F.when(F.col("chunk") == 0, F.concat(F.lit(">"), "ref", F.lit("\n"), lines)).otherwise(lines).alias("value"))


def write_fasta(chunks: DataFrame, path: str, size: int = CHUNK) -> None:
    """A folder of text, whose files in the order of their names are the references in the order of theirs."""
    fasta_lines(chunks, size).repartitionByRange("ref", "chunk").sortWithinPartitions("ref", "chunk").select("value").write.text(path)


def fasta_index(chunks: DataFrame, size: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """(ref, length, offset, bases, width): where the bases of each reference begin in the text, as in a ``.fai`` file."""
    length = cut(chunks.groupBy("ref").agg(F.max(F.col("chunk") * size + F.length("sequence")).alias("length")))
    # Header, bases, line ends.
    head = F.octet_length("ref") + 2
    sized = length.withColumn("bytes", head + F.col("length") + F.ceil(F.col("length") / width)).withColumn("head", head)
    return running_sum(sized, ["ref"], "bytes", "upto").select("ref", F.col("length").cast("long").alias("length"), (F.col("upto") - F.col("bytes") + F.col("head")).cast("long").alias("offset"), F.lit(width).alias("bases"), F.lit(width + 1).alias("width"))


# -- cutting out ------------------------------------------------------------


def block_sequences(blocks: DataFrame, chunks: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """(keys, sequence): the bases of the blocks (keys, ref, start, end), joined in the order of their starts.

    Bases beyond the reference are left out. Rows of one key meet in one row, so a key's blocks must be of bounded length.
    Blocks and chunks meet in a sort-merge join: Spark takes chunks that were made by an explode for much smaller than they
    are, and would broadcast a whole genome through the driver.
    """
    inside = blocks.filter((F.col("end") > F.col("start")) & (F.col("start") >= 0))
    each = inside.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    low = F.greatest(F.col("start"), F.col("chunk") * size)
    piece = F.substring("sequence", (low - F.col("chunk") * size + 1).cast("int"), (F.least(F.col("end"), (F.col("chunk") + 1) * size) - low).cast("int"))
    got = each.join(chunks.hint("merge"), ["ref", "chunk"]).select(*keys, F.struct("start", low.alias("low"), piece.alias("piece")).alias("p"))
    return got.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps")).select(*keys, F.array_join(F.transform("ps", lambda p: p.piece), "").alias("sequence"))


def transcript_sequences(transcripts: DataFrame, chunks: DataFrame, spliced: bool = True, size: int = CHUNK) -> DataFrame:
    """(t_id, sequence): along the transcript, of its exons or of its whole span."""
    blocks = F.col("exons") if spliced else F.array(F.struct("start", "end"))
    long = transcripts.select("t_id", "ref", "strand", F.explode(blocks).alias("b")).select("t_id", "strand", "ref", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))
    got = block_sequences(long, chunks, ["t_id", "strand"], size)
    return got.select("t_id", F.when(F.col("strand") == S.NEG, S.reverse_complement("sequence")).otherwise(F.col("sequence")).alias("sequence"))


def spliced_and_whole(transcripts: DataFrame, chunks: DataFrame, keys: list[str], size: int = CHUNK, reach: int = 0) -> DataFrame:
    """(keys, spliced, whole): both sequences along each transcript (keys, ref, start, end, strand, exons within the span), equal rows once.

    The span alone meets the chunks, and the exons are cut out of it. A span that lies within its first chunk and the
    ``reach`` next ones meets one row that has all of these, so that its bases are never exchanged; longer ones are put
    together of pieces. Where the reference has no base of a transcript's exons, there is no row.
    """
    inside = transcripts.filter((F.col("end") > F.col("start")) & (F.col("start") >= 0))
    far = F.floor((F.col("end") - 1) / size) - F.floor(F.col("start") / size) > reach
    both = _wholes_of_one(inside.filter(~far), chunks, keys, size, reach).unionByName(_wholes_of_pieces(inside.filter(far), chunks, keys, size))
    cut_out = F.transform(F.array_sort("exons"), lambda e: F.substring("whole", (e.start - F.col("start") + 1).cast("int"), (e.end - e.start).cast("int")))
    both = both.select(*keys, "strand", F.array_join(cut_out, "").alias("spliced"), "whole").filter("spliced <> ''")
    along = lambda c: F.when(F.col("strand") == S.NEG, S.reverse_complement(c)).otherwise(F.col(c)).alias(c)
    return both.select(*keys, along("spliced"), along("whole"))


def _wholes_of_one(spans: DataFrame, chunks: DataFrame, keys: list[str], size: int, reach: int) -> DataFrame:
    """(keys, start, strand, exons, whole) of spans that lie within ``reach`` chunks beyond their first."""
    long = chunks.select("ref", F.explode(F.sequence(F.greatest(F.col("chunk") - reach, F.lit(0)), F.col("chunk"))).alias("tile"), F.struct("chunk", "sequence").alias("p"))
    tiles = long.groupBy("ref", "tile").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("ref", "tile", F.array_join(F.transform("ps", lambda p: p.sequence), "").alias("sequence"))
    # Equal rows have equal places, so that they are made one where they meet the tile, without an exchange of their own.
    once = spans.select(*keys, "ref", F.floor(F.col("start") / size).alias("tile"), "start", "end", "strand", "exons").repartition("ref", "tile").distinct()
    whole = F.substring("sequence", (F.col("start") - F.col("tile") * size + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return once.join(tiles.hint("merge"), ["ref", "tile"]).select(*keys, "start", "strand", "exons", whole.alias("whole"))


def _wholes_of_pieces(spans: DataFrame, chunks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, start, strand, exons, whole) of spans of any length; what belongs to the transcript goes with its first chunk only."""
    chunk, first = F.col("chunk"), F.floor(F.col("start") / size)
    each = spans.withColumn("chunk", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / size))))
    low = F.greatest(F.col("start") - chunk * size, F.lit(0))
    each = each.select(*keys, "ref", "chunk", low.cast("int").alias("_low"), (F.least(F.col("end") - chunk * size, F.lit(size)) - low).cast("int").alias("_n"), F.when(chunk == first, F.struct("start", "strand", "exons")).alias("_own"))
    piece = F.struct(chunk.alias("chunk"), F.substring("sequence", F.col("_low") + 1, F.col("_n")).alias("piece"))
    got = each.join(chunks.hint("merge"), ["ref", "chunk"]).select(*keys, piece.alias("_p"), "_own")
    got = got.groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("_ps"), F.first("_own", ignorenulls=True).alias("_own")).filter("_own IS NOT NULL")
    return got.select(*keys, "_own.*", F.array_join(F.transform("_ps", lambda p: p.piece), "").alias("whole"))


# -- reads ------------------------------------------------------------------


def with_errors(sequence: str | Column, rate: float, seed: int, *cols: str | Column) -> Column:
    """Puts a base drawn from all four in about a ``rate`` of the places; draws are hashes of seed, columns and place."""
    if rate <= 0:
        return F.col(sequence) if isinstance(sequence, str) else sequence
    draw = lambda i, tag: F.xxhash64(F.lit(seed), F.lit(tag), *cols, i).bitwiseAND(F.lit((1 << 52) - 1))
    other = lambda i: F.substring(F.lit("ACGT"), (draw(i, "base") % 4 + 1).cast("int"), F.lit(1))
    bases = F.filter(F.split(sequence, ""), lambda b: b != "")
    return F.array_join(F.transform(bases, lambda b, i: F.when(draw(i, "hit") / float(1 << 52) < rate, other(i)).otherwise(b)), "")


def reads(fragments: DataFrame, chunks: DataFrame, read_length: int = 100, error_rate: float = 0.0, seed: int = 0, size: int = CHUNK) -> DataFrame:
    """(qname, r1, r2, q1, q2) of simulated fragments (qname, ref, strand, blocks, sense).

    The second read is the beginning of the fragment along its strand, the first one the reverse complement of its end;
    fragments that are not sense have them swapped. Qualities are all the highest.
    """
    long = fragments.select("qname", "strand", "sense", "ref", F.explode("blocks").alias("b")).select("qname", "strand", "sense", "ref", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))
    f = block_sequences(long, chunks, ["qname", "strand", "sense"], size)
    f = f.withColumn("s", F.when(F.col("strand") == S.NEG, S.reverse_complement("sequence")).otherwise(F.col("sequence")))
    n = F.least(F.lit(read_length), F.length("s"))
    begin, end = F.substring("s", F.lit(1), n), S.reverse_complement(F.substring("s", F.length("s") - n + 1, n))
    r1, r2 = F.when(F.col("sense"), end).otherwise(begin), F.when(F.col("sense"), begin).otherwise(end)
    out = f.select("qname", with_errors(r1, error_rate, seed, "qname", F.lit(1)).alias("r1"), with_errors(r2, error_rate, seed, "qname", F.lit(2)).alias("r2"))
    return out.select("qname", "r1", "r2", F.repeat(F.lit("I"), F.length("r1")).alias("q1"), F.repeat(F.lit("I"), F.length("r2")).alias("q2"))


def write_fastq(pairs: DataFrame, path: str, compression: str = "none") -> None:
    """Folders R1 and R2 of FASTQ text; mates are in the same place of files of the same number."""
    ordered = cut(pairs.repartitionByRange("qname").sortWithinPartitions("qname"))
    for k in (1, 2):
        text = F.concat(F.lit("@"), "qname", F.lit(f"/{k}\n"), f"r{k}", F.lit("\n+\n"), f"q{k}")
        ordered.select(text.alias("value")).write.option("compression", compression).text(f"{path}/R{k}")
