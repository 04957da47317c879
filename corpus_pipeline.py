"""From raw documents to tokens: toxic texts go, repeated lines and near copies go, leaked items go, the rest is encoded.

Each stage reads all rows that the one before kept. What all of them share:

* extra columns stay through all stages but the last, whatever their names; none is read but doc_id, text and n_chars
* repeated rows: each is judged like the others; near_dedup keeps one document of a group of equal texts
* empty table: no rows, with the same columns
* very long texts are read whole by every stage
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from episodica.llm.common import Scratch, documents, table, vocabulary_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Null and empty texts score low and stay. Without labels of both kinds nothing is learned and all documents stay.
    """
    return toxicity.without_toxic(spark, docs, table(spark, sf_dir, "labels"))


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text.

    A document of which nothing is left, as all its lines are later copies, goes. Null and empty texts, which had no lines
    to lose, stay as they are. Of equal lines the one with the smallest (doc_id, line number) stays; a null doc_id is the
    smallest.
    """
    text = F.coalesce("text", F.lit(""))
    left = line_dedup.delete_repeated_lines(spark, docs.withColumn(_HAD_TEXT, text != "")).filter(~F.col(_HAD_TEXT) | (text != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest doc_id.

    Null texts and texts without words are linked with nothing and stay.
    """
    return near_dedup.one_of_each_group(spark, docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; null and empty items are held by none. An empty benchmark leaves all documents.
    """
    return decontaminate.without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and what they decode to; a null or empty text has no tokens."""
    rows = bpe.encode(spark, docs, vocabulary_file("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


_HAD_TEXT = "__had_text"

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", delete_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaked),
    ("bpe", encode),
]

#: The toxicity stage learns from labels, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written to the shared folder and read again."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
