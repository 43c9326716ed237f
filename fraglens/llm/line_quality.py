"""Quality rules with cross-document line frequencies.

A line's key is the hash of its normalised form (lower case, digits as 0, white
space runs as one space). For each host, the documents that have a line are
counted, each document once whatever it repeats; copies of one text under several
ids count each. Lines in more than ``limit`` documents of their host are removed; a
document is rejected if that leaves under ``least_words`` words, or under
``least_share`` of its words, and it has lost any. Base rules on words, symbols and
repeats come with it.

All of it is DataFrame functions. Lines leave their document as a hash and a
word count; they are made distinct by document, so that a hot line is dealt out,
and then counted with a map-side combine. The join back is salted: a common line's
occurrences meet ``SALTS`` copies of its one row.

Special cases: null text has no words (base_failed is true); empty texts the same;
texts of any length are counted exactly; a null host is a host of its own; rows
of equal id are one document for the counts, a row without an id is the document
of its text; repeated rows get a row each; an empty table gives an empty result;
extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 100
LEAST_WORDS = 10
LEAST_SHARE = 0.2
#: Copies of a common line that its occurrences are joined with.
SALTS = 8
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


#: White space that is not one space between two words; runs of it become one.
UNEVEN = "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]"
#: Each three-word window of words with one space between them: found at its first word, which alone is passed over.
WINDOW = "(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++"


def spaced_words(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(text, UNEVEN, " "))


def n_spaced(words: Column) -> Column:
    """How many words ``spaced_words`` has returned."""
    return F.when(words == "", 0).otherwise(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1)


def repeated_words(w: str) -> Column:
    """Words in three-word windows that occur twice or more in the array column ``w``.

    Windows that may repeat are found by numbers: a hash in the upper bits, the position in the lower ones, as many as
    the text needs. Sorted, equal hashes are neighbours. No repeat is missed; what collides is then compared by its
    words, so that a text of any length is counted exactly.
    """
    at = "CAST(x.p AS INT)"
    return F.expr(f"""
      CASE WHEN size({w}) < 3 THEN 0L ELSE element_at(transform(array(length(bin(size({w})))), b ->
        aggregate(
          transform(array(transform(array(sort_array(transform(sequence(0, size({w}) - 3), i ->
            shiftleft(shiftright(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), b), b) + i))), s ->
              transform(filter(transform(s, (x, i) -> IF((i > 0 AND shiftright(x, b) = shiftright(s[i - 1], b)) OR (i < size(s) - 1 AND shiftright(x, b) = shiftright(s[i + 1], b)), x, NULL)), x -> x IS NOT NULL),
                x -> CAST(x - shiftleft(shiftright(x, b), b) AS INT)))[0]), m ->
            transform(array(sort_array(transform(m, p -> named_struct('k', concat_ws(' ', {w}[p], {w}[p + 1], {w}[p + 2]), 'p', p)))), s ->
              sort_array(transform(filter(s, (x, i) -> (i > 0 AND x.k = s[greatest(i - 1, 0)].k) OR (i < size(s) - 1 AND x.k = s[least(i + 1, size(s) - 1)].k)), x -> {at})))[0])[0],
          named_struct('n', 0L, 'till', -1L),
          (a, p) -> named_struct('n', a.n + p + 3 - greatest(CAST(p AS LONG), a.till), 'till', p + 3L),
          a -> a.n)), 1) END
    """)


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Functions over arrays of a row are interpreted, not compiled; only texts with fewer distinct windows than windows
    go through those of ``repeated_words``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.col("w_")
    lines = F.filter(F.split(t, "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({"w_": spaced_words(t), "l_": lines}).withColumn("n_words", n_spaced(w).cast("long"))
    distinct = F.size(F.array_distinct(F.regexp_extract_all(w, F.lit(WINDOW), F.lit(1))))
    out = out.withColumns({
        "word_chars": (F.char_length(w) - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
        "r_": F.when(distinct < F.col("n_words") - 2, F.split(w, " ")).otherwise(F.array().cast("array<string>")),
    })
    out = out.withColumn("n_repeat_words", repeated_words("r_").cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("w_", "l_", "r_")


def line_rows(docs: DataFrame) -> DataFrame:
    """(id, host, content, at, line, n): each line of each document with its normalised hash, its place and its words.

    Case and digits are folded once for the whole text; its line ends stay.
    """
    folded = F.regexp_replace(F.lower("text"), "[1-9]", "0")
    lines = docs.select("id", "host", F.xxhash64("text").alias("content"), F.posexplode(F.split(folded, "\n")).alias("at", "raw"))
    lines = lines.filter(F.ltrim("raw", F.lit(SPACES)) != "").withColumn("raw", spaced_words(F.col("raw")))
    return lines.select("id", "host", "content", "at", F.xxhash64("raw").alias("line"), n_spaced(F.col("raw")).alias("n"))


def words_in_common_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, host, content, n_removed): words in lines above the limit, for documents that have any; docs has id, host, text."""
    lines = line_rows(docs)
    document = F.when(F.col("id").isNull(), F.col("content")).alias("unnamed")
    spread = lines.select("host", "line", "id", document).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    common = spread.filter(F.col("n_docs") > limit).select(F.col("host").alias("h2"), F.col("line").alias("l2"), salts.alias("s2"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "content"), F.lit(SALTS)).cast("int"))
    hit = salted.join(common, (F.col("line") == F.col("l2")) & (F.col("salt") == F.col("s2")) & F.col("host").eqNullSafe(F.col("h2")), "left_semi")
    once = hit.groupBy("id", "host", "content", "at").agg(F.max("n").alias("n"))
    return once.groupBy("id", "host", "content").agg(F.sum("n").cast("long").alias("n_removed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed, base_failed, kept)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    # A document is its id, host and text; repeated rows are one.
    hits = words_in_common_lines(rows.filter("text is not null"), limit).select(F.col("id").alias("id2"), F.col("host").alias("h3"), F.col("content").alias("c2"), "n_removed")
    features = base_features(rows).withColumn("content", F.xxhash64("text")).drop("text")
    same = F.col("id").eqNullSafe(F.col("id2")) & F.col("host").eqNullSafe(F.col("h3")) & (F.col("content") == F.col("c2"))
    joined = features.join(hits, same, "left")
    gone = F.coalesce("n_removed", F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return joined.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_removed"), "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))
