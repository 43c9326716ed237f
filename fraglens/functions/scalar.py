"""Scalar expressions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, POS, NEG, AMBIGUOUS = 0, 1, 2, 3
COMPLEMENT = ("ACGTNacgtn", "TGCANtgcan")


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def strand_code(c: Column) -> Column:
    """'.', '+', '-', '?' as bit mask; anything else is an error."""
    return F.when(c == ".", NONE).when(c == "+", POS).when(c == "-", NEG).when(c == "?", AMBIGUOUS).otherwise(F.raise_error(F.concat(F.lit("strand: "), c)).cast("int"))


def strand_text(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ".+-?")), c.cast("int") + 1)


def opposite(c: Column) -> Column:
    """Swaps the two strand bits."""
    return F.shiftleft(c.bitwiseAND(F.lit(1)), 1).bitwiseOR(F.shiftright(c.bitwiseAND(F.lit(2)), 1))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, *COMPLEMENT))


def log_penalty(alpha: Column) -> Column:
    """log, minus infinity where not positive."""
    return F.when(alpha <= 0, F.lit(float("-inf"))).otherwise(F.log(F.when(alpha > 0, alpha)))


def strand_likelihood(exon: Column, gene: Column, p_sense: Column) -> Column:
    """p for equal strands, 1 - p for opposite ones, one half where either is unknown."""
    known = exon.isin(POS, NEG) & gene.isin(POS, NEG)
    return F.when(~known, 0.5).when(exon == gene, p_sense).otherwise(1 - p_sense)


def count_column(splice_type: Column, antisense: Column) -> Column:
    return splice_type * 2 + antisense.cast("int")


def fragment_class(chimeric: Column, hits: Column, candidates: Column, opposite_strands: Column) -> Column:
    """Priority: chimeric 4, multimapper 3, opposite strands 2, same strand ambiguous 1, unambiguous 0."""
    return F.when(chimeric, 4).when(hits > 1, 3).when(opposite_strands, 2).when(candidates > 1, 1).otherwise(0)


def coverage_weight(start: Column, end: Column, length: Column, ramp: float = 200.0) -> Column:
    """Weight of a fragment under a trapezoid of coverage: 1 in the middle, more towards the ends.

    Coverage rises to its plateau over w = min(ramp, length / 2) from either end; the weight is w by the mean height over
    the fragment. Intervals without length weigh 1.
    """
    w = F.least(F.lit(ramp), length / 2)
    area = lambda x: F.when(x <= w, x * x / 2).when(x <= length - w, w * w / 2 + w * (x - w)).otherwise(w * (length - w) - (length - x) * (length - x) / 2)
    s, e = F.greatest(start, F.lit(0)), F.least(end, length)
    mean = (area(e) - area(s)) / F.nullif(e - s, F.lit(0))
    return F.when((length <= 0) | (e <= s), 1.0).otherwise(w / F.greatest(mean, F.lit(1.0)))


def bias_correction(log_lik: Column, length: Column, frag: Column) -> Column:
    return log_lik - F.log(F.greatest(length - frag + 1, F.lit(1)))


def bases_before(exons: str, pos: str) -> str:
    """Bases of sorted exons before a place, as SQL text."""
    return f"aggregate({exons}, 0L, (a, e) -> a + greatest(0L, least({pos}, e.end) - e.start))"


def transcript_position(exons: str, pos: str, strand: str | None = None) -> Column:
    """Position along sorted exons (array of structs start, end), clamped to [0, length]; mirrored on the minus strand."""
    along = bases_before(exons, pos)
    total = f"aggregate({exons}, 0L, (a, e) -> a + (e.end - e.start))"
    return F.expr(f"CASE WHEN {strand} = 2 THEN {total} - {along} ELSE {along} END" if strand else along)


def introns(exons: str) -> Column:
    """Array of structs start, end between neighbouring exons."""
    return F.expr(f"CASE WHEN size({exons}) < 2 THEN cast(array() as array<struct<start:bigint,end:bigint>>) ELSE transform(sequence(1, size({exons}) - 1), i -> named_struct('start', cast({exons}[i - 1].end as bigint), 'end', cast({exons}[i].start as bigint))) END")


def spliced_length(exons: str) -> Column:
    return F.expr(f"aggregate({exons}, 0L, (a, e) -> a + (e.end - e.start))")


def key_values(text: Column) -> Column:
    """``key "value";`` pairs as a map from key to the list of its values, tags left out."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(r'(\S+)\s+"([^"]*)"'), 1).alias("k"), F.regexp_extract_all(text, F.lit(r'(\S+)\s+"([^"]*)"'), 2).alias("v"))
    keys = F.array_distinct(F.filter(F.transform(pairs, lambda p: p.k), lambda k: k != "tag"))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p.k == k), lambda p: p.v))))


def tags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?:^|[\s;])tag\s+"([^"]*)"'), 1))


def winner_flags(synthetic: Column, nascent: Column, gdna: Column) -> Column:
    """Outcome bits: 1 assigned, 2 mature, 4 genomic, 8 nascent, 16 synthetic; synthetic before nascent before mature."""
    return F.when(gdna, 1 | 4).when(synthetic, 1 | 8 | 16).when(nascent, 1 | 8).otherwise(1 | 2)


def condition_parts(name: Column) -> tuple[Column, Column, Column]:
    """(genomic label, strand specificity, nascent label) of a condition's name, ``gdna_x_ss_y_nrna_z`` in any order; unknown, 1.0 and none where it does not say."""
    after = lambda k: F.nullif(F.regexp_extract(name, rf"(?:^|_){k}_([^_]*)", 1), F.lit(""))
    return F.coalesce(after("gdna"), F.lit("unknown")), F.coalesce(after("ss").try_cast("double"), F.lit(1.0)), F.coalesce(after("nrna"), F.lit("none"))


def place_weight(length: Column, mean: float) -> Column:
    """Places of a mean fragment in a sequence, none where it does not fit."""
    return F.greatest(length - mean + 1, F.lit(0.0))
