"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm import (
    bpe,
    byte_bpe,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    hard_negatives,
    language,
    line_dedup,
    near_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    window_dedup,
)
from episodica.llm.common import documents, table, vocabulary_file


def byte_pattern() -> str:
    """The split pattern that goes with the rank file, as its folder states it."""
    spec = importlib.util.spec_from_file_location("vocabulary_files", vocabulary_file("__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_dedup(spark, documents(spark, sf_dir))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(spark, documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(spark, documents(spark, sf_dir), vocabulary_file("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(spark, documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(spark, documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.tiktoken"), byte_pattern())


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_dedup.window_dedup(spark, documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode(spark, documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.tiktoken"), byte_pattern())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row carries a shifted label, every fiftieth is an anchor."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.hard_negatives(spark, rows, F.col("id") % 50 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(spark, documents(spark, sf_dir), with_restored=True)
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_exact_dedup,
        op2_near_dedup,
        op3_suffix_dedup,
        op4_bpe,
        op5_line_dedup,
        op6_language_id,
        op7_decontaminate,
        op8_toxicity,
        op9_window_dedup,
        op10_token_counts,
        op11_byte_bpe,
        op12_hard_negatives,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in made}


EXACT_SQL = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t
  FROM documents),
ranked AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
"""

NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS c
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (total - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS c FROM sets
  UNION SELECT e.a, r.c FROM reach r JOIN edges e ON e.b = r.v),
least AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON v = doc_id
"""

SUFFIX_SQL = r"""
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM texts),
starts AS (SELECT doc_id, unnest(range(n - 399)) AS pos, h FROM sized WHERE n >= 400),
strings AS (SELECT doc_id, pos, md5(substring(h, 2 * pos + 1, 800)) AS s FROM starts),
repeated AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY s) > 1 AS again FROM strings),
bytes AS (SELECT doc_id, unnest(range(n)) AS pos, unnest(regexp_extract_all(h, '..')) AS byte FROM sized),
covered AS (
  SELECT b.doc_id, b.pos, byte,
         coalesce(bool_or(again) OVER (PARTITION BY b.doc_id ORDER BY b.pos
           ROWS BETWEEN 399 PRECEDING AND CURRENT ROW), false) AS gone
  FROM bytes b LEFT JOIN repeated r USING (doc_id, pos)),
marked AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM covered),
summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
         string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM sized LEFT JOIN summed USING (doc_id)
"""

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
pairs AS (
  SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next_line FROM lines),
numbered AS (
  SELECT doc_id, pos,
         row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, pos) AS copy
  FROM pairs WHERE next_line IS NOT NULL),
long AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM lines)
  WHERE copy > 1 AND len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 50),
gone AS (
  SELECT doc_id, pos + k AS pos FROM numbered, (VALUES (0), (1)) AS s(k) WHERE copy > 1
  UNION SELECT doc_id, pos FROM long),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone,
         lag(g.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS before
  FROM lines l LEFT JOIN gone g USING (doc_id, pos)),
summed AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN summed s USING (doc_id)
"""


LEAK_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
sets AS (
  SELECT kind, id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM words),
items AS (SELECT id AS item_id, len(s) AS n, unnest(s) AS g FROM sets WHERE kind = 'b'),
grams AS (SELECT id AS doc_id, unnest(s) AS g FROM sets WHERE kind = 'd')
SELECT doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared
FROM items JOIN grams USING (g) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""

WINDOW_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(range(len(w) - 49)) AS pos, w FROM words WHERE len(w) >= 50),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS h FROM starts),
judged AS (
  SELECT doc_id, pos, doc_id > min(doc_id) OVER (PARTITION BY h) AS gone FROM windows),
places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words),
marked AS (
  SELECT p.doc_id, p.pos, word, coalesce(bool_or(gone) OVER (PARTITION BY p.doc_id ORDER BY p.pos
           ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM places p LEFT JOIN judged j USING (doc_id, pos)),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s USING (doc_id)
"""


NEGATIVES_SQL = r"""
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM used a JOIN used b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

MIDDLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM units),
cut AS (
  SELECT doc_id, t, n,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": EXACT_SQL,
        "op2_near_dedup": NEAR_SQL,
        "op3_suffix_dedup": SUFFIX_SQL,
        "op5_line_dedup": LINE_SQL,
        "op7_decontaminate": LEAK_SQL,
        "op9_window_dedup": WINDOW_SQL,
        "op12_hard_negatives": NEGATIVES_SQL,
        "op13_fill_in_middle": MIDDLE_SQL,
    }
