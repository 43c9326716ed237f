"""Fill-in-the-middle transformation by a two-pass streaming matcher of constant memory.

A text is cut into units, runs of ASCII letters or single other characters, matched
left to right. The first pass over the lazy match iterator only counts them; two
ranks are drawn from the id and that count; the second pass advances a fresh iterator
to the lower rank and on to the higher one, and notes where it stands. No list of
units or offsets is ever kept: besides the text and its result, a document needs a
counter and two positions, however long it is. ``restored`` undoes the change out of
result and form alone, as a column expression.

Special cases: a null text is empty, an empty one is plain; a text that has one of
the marks is plain, since its result could not be read back; a null id draws from
the seed with nothing behind it; equal ranks give an empty middle, ranks at the ends
an empty prefix or suffix; texts of any length are cut whole, one row at a time;
repeated rows give equal rows; an empty table gives an empty result; extra columns,
whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, so many are changed at all; of these, so many of 100 have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SLICE_BYTES = 2 << 20
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))  # type: ignore[return-value]


def position(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The characters before which ``lo`` and ``hi`` units end; the iterator is advanced, nothing of it is kept."""
    units = UNIT.finditer(text)
    first = next(islice(units, lo - 1, None)).end() if lo else 0
    return first, next(islice(units, hi - lo - 1, None)).end() if hi > lo else first


def infill(doc_id: int | None, text: str, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output)"""
    n = sum(1 for _ in UNIT.finditer(text))
    a, b, change, order = draws(doc_id, seed)
    if not text or change % 100 >= CHANGED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m = position(text, lo, hi)
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", p, m - p, "".join((SUFFIX, text[m:], PREFIX, text[:p], MIDDLE, text[p:m]))
    return n, "psm", p, m - p, "".join((PREFIX, text[:p], SUFFIX, text[m:], MIDDLE, text[p:m]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): all documents, with their texts put into the form drawn for them."""

    @B.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for part in T.slices(batch, "text", SLICE_BYTES):
                ids = part.column("doc_id").to_pylist()
                rows = [(d, *infill(d, t.as_py() or "", seed)) for d, t in zip(ids, part.column("text"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a result was made of. A changed text has no mark in it, so that each mark is found once."""
    between = lambda x, a, b: F.substring_index(F.substring_index(x, a, -1), b, 1)
    x = F.col(output)
    middle = F.substring_index(x, MIDDLE, -1)
    psm = F.concat(between(x, PREFIX, SUFFIX), middle, between(x, SUFFIX, MIDDLE))
    spm = F.concat(between(x, PREFIX, MIDDLE), middle, between(x, SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(x)
