"""The queries of the training-data operators, one for each, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_wrapper, infilling, language_gru, line_quality, minhash, ppm, quality_zstd, ranked_search, simhash, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru.identify(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), layout=False)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_wrapper.extract_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_zstd.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = infilling.fill_in_middle(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infilling.restored(), 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_language_id, op3_lm_score, op4_substring_dedup, op5_html_text, op6_decontaminate, op7_quality_rules, op8_quality_score, op9_bpe, op10_simhash, op11_minhash, op12_ranked_search, op13_fill_in_middle, pipeline)
    return {f.__name__: f for f in own}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op1_sql() -> str:
    rules = sorted(url_filter.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"((host = {_quoted(r[1])} OR ends_with(host, {_quoted('.' + r[1])})) AND starts_with(path, {_quoted(r[2])}))"
    rule = " ".join(f"WHEN {fits(r)} THEN {_quoted(r[1] + r[2])}" for r in rules)
    action = " ".join(f"WHEN {fits(r)} THEN {_quoted(r[0])}" for r in rules)
    named = "least(" + ", ".join(f"CASE WHEN regexp_matches(low, {_quoted(p)}) THEN {_quoted(n)} END" for n, _, p in url_filter.PATTERNS) + ")"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {named} AS pattern FROM parts)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {action} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM split"""


WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP4_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS first FROM starts GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM starts JOIN firsts USING (k), range(0, 13) t(j) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_ALNUM = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i+n-1], ' ') AS k FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP11_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END)) AS x FROM w),
sets AS (SELECT x, min(doc_id) AS id, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x),
sh AS (SELECT id, n, unnest(x) AS k FROM sets),
links AS (SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(id, c) AS (SELECT id, id FROM sets UNION SELECT CASE WHEN l.a = r.id THEN l.b ELSE l.a END, r.c FROM reach r JOIN links l ON l.a = r.id OR l.b = r.id),
label AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN sets ON sets.x = s.x LEFT JOIN label ON label.id = sets.id"""

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
stats AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, term, n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_ALNUM}) AS term FROM benchmark)),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, stats WHERE term IN (SELECT term FROM q)),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM tf JOIN weight USING (term), stats),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""

_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, len(u) AS n, {_H.format(1)} % (len(u) + 1) AS a, {_H.format(9)} % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H.format(17)} % 100 >= 90 THEN 'plain' WHEN {_H.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""

_HAS_WORD = "regexp_matches(x, '[^\\x20\\x09-\\x0D]')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_HAS_WORD}) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line,
  len(list_filter(regexp_split_to_array(raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, source, text, unnest(ls) AS raw FROM d)),
common AS (SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT doc_id) > {line_quality.LIMIT}),
gone AS (SELECT doc_id, sum(n) AS n FROM lines SEMI JOIN common USING (source, line) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed FROM d LEFT JOIN reps USING (doc_id) LEFT JOIN gone USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < {line_quality.LEAST_WORDS} OR n_words - n_removed < {line_quality.LEAST_SHARE} * n_words)) AS kept FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op4_substring_dedup": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_quality_rules": OP7_SQL, "op11_minhash": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
