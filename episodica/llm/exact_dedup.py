"""Exact dedup by content sort, in DataFrame operations only.

Texts are compared without white space. Sampled splitters range-partition the normalised texts, an external sort puts
equal ones next to each other, and the sort-based aggregate compares whole neighbouring texts. The splitters are drawn
from the first characters, a hash of the whole text and a salt of the doc_id: the sample that reaches the driver holds
short keys only, texts with one long common beginning still spread, and a text that fills a third of all rows is cut over
many ranges, each of which becomes one row before the parts of a group meet under the digest of the text.

* null text: an empty text; all empty texts are one group
* ties in length: the smallest doc_id stays; a null doc_id is the smallest
* repeated rows: each is counted and returned; those that carry the kept doc_id are all marked kept
* empty table: no rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from episodica.llm.common import per_key

BLANKS = r"[\x20\x09-\x0D]+"
HEAD_CHARS = 24
SALTS = 64


def normalised(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("n_chars"),
        F.regexp_replace(text, BLANKS, "").alias("norm"),
    )


def sorted_groups(docs: DataFrame) -> DataFrame:
    """One row per group of equal texts: text_sha256, the row that stays as (-n_chars, doc_id), group_size."""
    keyed = normalised(docs).select(
        F.substring("norm", 1, HEAD_CHARS).alias("head"),
        F.xxhash64("norm").alias("body"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"),
        "norm",
        F.struct((-F.col("n_chars")).alias("shortness"), "doc_id").alias("rank"),
    )
    parts = (
        keyed.repartitionByRange("head", "body", "salt")
        .groupBy("head", "body", "salt", "norm")
        .agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    digests = parts.select(F.sha2("norm", 256).alias("text_sha256"), "best", "n")
    return per_key(digests, ["text_sha256"], F.min("best").alias("best"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = normalised(docs).select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    groups = sorted_groups(docs).select(
        "text_sha256", "group_size", F.col("best.doc_id").alias("keep_id")
    )
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
