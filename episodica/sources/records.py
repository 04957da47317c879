"""Records of CSV files whose quoted fields hold line breaks, read in splits.

A task that starts in the middle of a file cannot know whether it is inside a quoted field. What it can know is what each
line does to that state: a line is a function from the state before it to the state after it, and functions of lines
compose. So lines are composed within their split, splits within their file (a few rows), and every line then knows the
state it begins in. A record begins on a line that begins outside quotes; the lines of a record are put together, most
records being one line that no grouping touches.

A quote opens a field only at the field's start, doubled quotes stand for one, and a quote elsewhere in an unquoted field
is a character, as in the rows that Spark's own reader makes of whole files.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from episodica.sources.stages import stage_root

_SPLIT = ["file", "at"]


def line_states(line: Column, sep: str) -> Column:
    """Struct (o, i): whether the line ends inside quotes if it begins outside (o) or inside (i) of them."""

    def step(inside: Column, part: Column) -> Column:
        odd = F.length(part) % 2 != F.length(F.replace(part, F.lit('"'), F.lit(""))) % 2
        # Outside, a part is quoted if it starts so, and open if its quotes do not pair up. Inside, a lone quote closes.
        return F.when(inside, ~odd).otherwise(part.startswith('"') & odd)

    begin = F.struct(F.lit(False).alias("o"), F.lit(True).alias("i"))
    states = F.aggregate(
        F.split(line, re.escape(sep), -1), begin, lambda s, part: F.struct(step(s["o"], part).alias("o"), step(s["i"], part).alias("i"))
    )
    # Most lines hold no quote and change nothing.
    return F.when(line.contains('"'), states).otherwise(begin)


def _composed(rows: DataFrame, along: WindowSpec) -> DataFrame:
    """Add ``ends`` (o, i): the state after each row if the stretch begins outside or inside of quotes.

    A row either sets the state, keeps it or flips it. The state is what the last setting row made, flipped by the
    flips after it.
    """
    up_to = along.rowsBetween(Window.unboundedPreceding, 0)
    o, i = F.col("o"), F.col("i")
    rows = rows.withColumn("__flips", F.sum(F.when(o & ~i, 1).otherwise(0)).over(up_to))
    rows = rows.withColumn("__set", F.last(F.when(o == i, F.struct(o.alias("to"), F.col("__flips").alias("flips"))), ignorenulls=True).over(up_to))
    flipped = (F.col("__flips") - F.coalesce("__set.flips", F.lit(0))) % 2 == 1
    ends = [(F.coalesce("__set.to", F.lit(begin)) != flipped).alias(name) for name, begin in (("o", False), ("i", True))]
    return rows.withColumn("ends", F.struct(*ends)).drop("__flips", "__set")


def _placed_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Every line with what its split knows of it, for either state (o, i) in which the split may begin.

    Columns: file, at (where the split begins), n (number of the line in it), value, and structs over o and i: before
    (state before the line), ends (state after it) and start (number of the last line so far that begins a record). One
    exchange, one sort; the lines are stored, as all further steps read them.
    """
    scanned = spark.read.option("lineSep", "\n").text(path)
    lines = scanned.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        # Only its order within a split counts, which does not depend on the task that read it.
        F.monotonically_increasing_id().alias("__row"),
        "value",
        F.inline(F.array(line_states(F.col("value"), sep))),
    )
    along = Window.partitionBy(*_SPLIT).orderBy("__row")
    lines = _composed(lines, along)
    outside = F.struct(F.lit(False).alias("o"), F.lit(True).alias("i"))
    lines = lines.withColumn("before", F.coalesce(F.lag("ends").over(along), outside)).withColumn("n", F.row_number().over(along))
    up_to = along.rowsBetween(Window.unboundedPreceding, 0)
    starts = [F.max(F.when(~F.col(f"before.{s}"), F.col("n"))).over(up_to).alias(s) for s in ("o", "i")]
    placed = lines.select(*_SPLIT, "n", "value", "before", "ends", F.struct(*starts).alias("start"))
    folder = f"{stage_root(spark)}/lines/{uuid.uuid4().hex}"
    placed.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder)


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """One column ``record``: every record of every file but the header, its own line breaks kept."""
    lines = _placed_lines(spark, path, sep)
    in_file = Window.partitionBy("file").orderBy("at")
    splits = lines.groupBy(*_SPLIT).agg(F.max_by("ends", "n").alias("whole"), F.max("start.o").alias("so"), F.max("start.i").alias("si"))
    splits = _composed(splits.select(*_SPLIT, "so", "si", "whole.*"), in_file)
    splits = splits.withColumn("inside", F.coalesce(F.lag("ends.o").over(in_file), F.lit(False)))
    last = F.when(F.col("inside"), F.col("si")).otherwise(F.col("so"))
    # The record that goes on at the start of a split began in one before it.
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.max(F.when(last.isNotNull(), F.struct("at", last.alias("n")))).over(earlier)
    splits = splits.select(*_SPLIT, "inside", carried.alias("carried"))

    def known(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}.i")).otherwise(F.col(f"{name}.o"))

    # One small row per split, however long its lines: lines are not moved again for it.
    placed = lines.join(F.broadcast(splits), _SPLIT).select(
        "file", "at", "n", "value", known("before").alias("goes_on"), known("ends").alias("open"), known("start").alias("start"), "carried"
    )
    began = F.when(F.col("start").isNotNull(), F.struct("at", F.col("start").alias("n"))).otherwise(F.col("carried"))
    header = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(1).alias("n"))
    several = F.col("goes_on") | F.col("open")
    single = placed.filter(~several & (F.struct("at", "n") != header)).select(F.col("value").alias("record"))
    joined = (
        placed.filter(several)
        .select("file", began.alias("began"), "at", "n", "value")
        .filter(F.col("began") != header)
        .groupBy("file", "began")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n", "value"))).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    )
    whole = F.regexp_replace("record", "\r$", "")
    return single.union(joined).select(whole.alias("record")).filter(F.col("record") != "")
