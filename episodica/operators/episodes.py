"""Raw rows to clean episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.temporal import add_years, parse_date, parse_day_first
from episodica.schema import EpisodeConfig

MAX_BROADCAST_OVERRIDES = 10_000


def has_admission(text: str = S.ADMISSION_TEXT) -> Column:
    return F.col(text).isNotNull() & (F.col(text) != V.ADMISSION_SENTINEL)


def request_date(raw: DataFrame) -> Column:
    """The request date; texts, as extracts give them, are parsed so that dates compare as dates."""
    if raw.schema[S.REQUEST_DATE].dataType.simpleString() == "string":
        return parse_date(S.REQUEST_DATE)
    return F.col(S.REQUEST_DATE)


def collapse_episodes(raw: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    """One row per (subject, admission text).

    Copies of a row meet in the map-side half of the aggregate, so a pair that
    holds a large share of the input shuffles one row per task. Attributes take
    their smallest non-null value, which does not depend on row order.
    """
    if cfg.discharge_reduce == "lexical_max":
        discharge = F.max(S.DISCHARGE_TEXT)
    elif cfg.discharge_reduce == "chronological_max":
        text = F.col(S.DISCHARGE_TEXT)
        discharge = F.max(F.struct(parse_discharge(text).alias("t"), text.alias("text")))["text"]
    else:
        raise ValueError(f"unknown discharge_reduce: {cfg.discharge_reduce}")
    return (
        raw.filter(has_admission())
        .groupBy(S.ID, S.ADMISSION_TEXT)
        .agg(
            discharge.alias(S.DISCHARGE_TEXT),
            F.max(request_date(raw)).alias("last_update"),
            *[F.min(c).alias(c) for c in cfg.attributes],
        )
    )


def parse_discharge(text: Column | str) -> Column:
    """Discharge text to time; blank and sentinel texts are NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return parse_day_first(F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit(V.DISCHARGE_SENTINEL)))


def with_admission_time(df: DataFrame, cfg: EpisodeConfig = EpisodeConfig(), name: str = S.ADMISSION) -> DataFrame:
    """Add the admission time: an override by (subject, text) first, then year shifts, else as parsed."""
    # A column of its own, so that the text is parsed once however often the rules look at it.
    df = df.withColumn("__parsed", parse_day_first(S.ADMISSION_TEXT))
    parsed = F.col("__parsed")
    shifted = F
    for year, years in cfg.year_shifts:
        shifted = shifted.when(F.year(parsed) == year, add_years(parsed, years))
    shifted = shifted.otherwise(parsed) if cfg.year_shifts else parsed
    if not cfg.overrides:
        return df.withColumn(name, shifted).drop("__parsed")
    table = df.sparkSession.createDataFrame(
        list(cfg.overrides), f"`__id` string, `__text` string, `__time` string"
    ).select("__id", "__text", F.col("__time").cast("timestamp_ntz").alias("__time"))
    if len(cfg.overrides) <= MAX_BROADCAST_OVERRIDES:
        table = F.broadcast(table)
    hit = (F.col(S.ID) == F.col("__id")) & (F.col(S.ADMISSION_TEXT) == F.col("__text"))
    return (
        df.join(table, hit, "left")
        .withColumn(name, F.coalesce(F.col("__time"), shifted))
        .drop("__id", "__text", "__time", "__parsed")
    )


def clean_episodes(episodes: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    """Episodes with admission and discharge times."""
    return with_admission_time(episodes, cfg).withColumn(S.DISCHARGE, parse_discharge(S.DISCHARGE_TEXT))
