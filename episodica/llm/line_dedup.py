"""Line dedup in DataFrame operations only: repeated runs of lines by prefix doubling.

A corpus is a sequence of line identities per document. A class of depth h holds the positions whose next h lines are the
same; it is one interval of the suffix array in which the longest common prefix is h or more. Its rank is the smallest
position (document, line) it holds. Depth 1 ranks lines by a 128-bit digest; each doubling ranks pairs of ranks (here and
h lines on), the last step overlapping so that the depth ends at ``min_lines`` exactly. Positions that are alone in their
class leave at once, so later rounds see repeated lines only. A position that is not the smallest of its class starts a
later copy; the lines its copies cover merge into maximal runs and are deleted. Windows are judged on the input, not on
what is left. Every ``min_lines`` lines of a longer repeated run are repeated too, so the merged windows are the maximal
runs and deeper classes would add no line.

A run of fewer lines counts if one of its lines has ``long_words`` words or more: such a line is a later copy by itself, at
depth 1, whatever its neighbours are. ``long_words=None`` leaves this out. Words are separated by ASCII white space.

Ranks come from a hash aggregate with partial sums per task and return by a join that may be split where a class is
large, so a line that a third of all documents share does not meet in one task.

* null or empty text: no or one (empty) line; never deleted below the depth, as it is not long
* blank lines are lines like others
* ties: (doc_id, line number) orders copies; a null doc_id comes first
* repeated rows of one doc_id and text count as one document and get the same result
* empty table: no rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodica.llm.common import ROW_KEY, Scratch, id_of, per_key, row_key

MIN_LINES = 2
LONG_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_long(content: Column, words: int | None) -> Column:
    if words is None:
        return F.lit(False)
    found = F.filter(F.split(content, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Short lines are not split: so many words have so many characters at least.
    return (F.char_length(content) >= 2 * words - 1) & (F.size(found) >= words)


def _ranked(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Repeated classes of the keys: each position with the smallest position of its class as rank."""
    classes = per_key(rows, keys, F.min("at").alias("first"), F.max("at").alias("last"))
    repeated = classes.filter("first <> last").select(*keys, F.col("first").alias("rank"))
    return rows.join(repeated, keys).select("at", "rank", *more)


def repeated_lines(docs: DataFrame, long_words: int | None, scratch: Scratch) -> DataFrame:
    """Positions (at: did, rk, line) of lines that occur elsewhere too, with their rank and whether the line is long."""
    # The key is computed before the text is taken apart, or every line would carry the whole text along.
    keyed = docs.select(*row_key(), _lines(F.col("text")).alias("lines"))
    lines = keyed.select(*ROW_KEY, F.posexplode("lines").alias("line", "content"))
    sequence = scratch.table(
        lines.select(
            F.struct(*ROW_KEY, "line").alias("at"),
            F.unhex(F.md5("content")).alias("identity"),
            _is_long(F.col("content"), long_words).alias("long"),
        )
    )
    return scratch.table(_ranked(sequence, ["identity"], "long"))


def repeated_positions(single: DataFrame, min_lines: int, scratch: Scratch) -> DataFrame:
    """Positions whose next ``min_lines`` lines occur elsewhere too, with their rank, from those of single lines."""
    ranked, depth = single, 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ahead = Window.partitionBy("at.did", "at.rk").orderBy("at.line").rangeBetween(step, step)
        pairs = ranked.select("at", F.col("rank").alias("here"), F.min("rank").over(ahead).alias("there"))
        pairs = pairs.filter("there IS NOT NULL")
        ranked, depth = scratch.table(_ranked(pairs, ["here", "there"])), depth + step
    return ranked


def later_copies(
    spark: SparkSession, docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """Documents that lose lines: row key and the sorted numbers of the lines to delete."""
    scratch = Scratch(spark, "lines")
    single = repeated_lines(docs, long_words, scratch)
    starts = repeated_positions(single, min_lines, scratch).filter("at <> rank")
    covered = starts.select(
        "at.did", "at.rk", F.explode(F.sequence("at.line", F.col("at.line") + (min_lines - 1))).alias("line")
    )
    if long_words is not None:
        covered = covered.union(single.filter("long AND at <> rank").select("at.did", "at.rk", "at.line"))
    return scratch.table(covered.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_set("line")).alias("gone")))


def with_kept_text(
    spark: SparkSession, docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """Rows (row, lines, gone, kept): the input row, its lines, deleted line numbers and the text that is left."""
    rows = docs.select(*row_key(), F.struct("*").alias("row"))
    gone = later_copies(spark, docs, min_lines, long_words).hint("shuffle_hash")
    joined = rows.join(gone, ROW_KEY, "left").withColumn("lines", _lines(F.col("row.text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    )
    return joined.withColumn("kept", kept)


def line_dedup(
    spark: SparkSession, docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs (maximal deleted runs), kept_sha256."""
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return with_kept_text(spark, docs, min_lines, long_words).select(
        id_of(F.col("did")).alias("doc_id"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(F.array_except(gone, F.transform(gone, lambda i: i + 1))).cast("long").alias("n_runs"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def delete_repeated_lines(
    spark: SparkSession, docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """The documents with later copies of line runs deleted from ``text``; all columns and rows stay."""
    columns = [F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return with_kept_text(spark, docs, min_lines, long_words).select(*columns)
