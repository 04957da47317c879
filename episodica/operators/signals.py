"""Rules that tell an unplanned recurrence from a planned one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodica import schema as S
from episodica.functions import vocabulary as V
from episodica.functions.temporal import parse_time
from episodica.functions.text import any_of, blank_to_null, contains_any, distinct_text, without_accents
from episodica.operators.episodes import has_admission, with_admission_time
from episodica.operators.heavy import SLICE, cut, find_heavy_keys
from episodica.schema import EpisodeConfig

SEPARATOR = " | "
#: A group with more distinct texts is put together from chunks of at most so many.
HEAVY_TEXTS, TEXTS_PER_CHUNK = 100_000, 10_000

FLAGS = ("acute_procedure", "routine_procedure", "transplant", "post_transplant")


def raw_procedure_rows(raw: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    """(subject, admission time, procedure) of raw rows.

    Episodes are the distinct (subject, admission text) pairs of the same raw
    rows, so every row kept here has its episode and no join is needed. Copies
    meet first, so times and rule texts are read once per distinct row.
    """
    text = blank_to_null(F.col("procedimentosolicitado").cast("string"))
    rows = raw.filter(has_admission()).select(S.ID, S.ADMISSION_TEXT, text.alias("procedure")).distinct()
    return with_admission_time(rows, cfg).select(S.ID, S.ADMISSION, "procedure")


def billing_procedure_rows(billing: DataFrame) -> DataFrame:
    """(subject, admission time, procedure) of billing rows; four columns joined."""
    parts = [F.col(c).cast("string") for c in S.BILLING_PROCEDURES]
    return billing.select(
        S.ID,
        billing_time(billing).alias(S.ADMISSION),
        blank_to_null(F.concat_ws(" | ", *parts)).alias("procedure"),
    )


def billing_time(billing: DataFrame) -> Column:
    kind = billing.schema[S.ADMISSION_TEXT].dataType.simpleString()
    if kind == "string":
        return parse_time(S.ADMISSION_TEXT)
    return F.col(S.ADMISSION_TEXT).cast("timestamp_ntz")


def unparsed_billing_times(billing: DataFrame) -> DataFrame:
    """Number of billing rows whose admission time is given and cannot be read."""
    given = blank_to_null(F.col(S.ADMISSION_TEXT).cast("string")).isNotNull()
    return billing.agg(F.count_if(given & billing_time(billing).isNull()).alias("unparsed_times"))


def procedure_texts(rows: DataFrame, heavy_texts: int = HEAVY_TEXTS, texts_per_chunk: int = TEXTS_PER_CHUNK) -> DataFrame:
    """Distinct procedures per (subject, admission time) as one text.

    A group with many distinct texts, such as the rows without a time of one subject, is not collected as one array: its
    texts are sorted across tasks, joined chunk by chunk, and the chunks are put together in their order.
    """
    kept = rows.dropDuplicates([S.ID, S.ADMISSION, "procedure"])
    groups = kept.withColumn("__group", F.struct(S.ID, S.ADMISSION))
    heavy = find_heavy_keys(groups, "__group", heavy_texts, texts_per_chunk) if rows.count() > heavy_texts else None
    if heavy is None:
        return _joined(kept, [S.ID, S.ADMISSION], "procedure", "procedure_text")
    light = _joined(heavy.without(groups, "__group"), [S.ID, S.ADMISSION], "procedure", "procedure_text")
    texts = heavy.only(groups, "__group").filter(F.col("procedure").isNotNull()).select("__group", "procedure")
    chunks = cut(texts, "__group", [F.col("procedure").asc()], heavy).rows
    parts = _joined(chunks, ["__group", SLICE], "procedure", "part")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(SLICE, "part"))), lambda p: p["part"]), SEPARATOR)
    long = parts.groupBy("__group").agg(whole.alias("procedure_text"))
    return light.unionByName(long.select("__group.*", "procedure_text"))


def _joined(rows: DataFrame, by: list[str], text: str, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(distinct_text(text, SEPARATOR).alias(name))


def _folded(text: Column, cfg: EpisodeConfig) -> Column:
    text = F.upper(text)
    return without_accents(text) if cfg.fold_accents else text


def procedure_flags(rows: DataFrame, cfg: EpisodeConfig = EpisodeConfig()) -> DataFrame:
    """Which rule texts occur, per (subject, admission time).

    The rules only ask whether a text occurs in any procedure, and no fragment
    spans two procedures, so flags per row and their maximum say the same as
    the joined text. Rows without any rule text are dropped by one pattern
    before the shuffle. A row whose time does not parse keeps a NULL time and
    matches nothing; a filter on the time would be pushed below and parse twice.
    """
    text = _folded(F.col("procedure"), cfg)
    fragments = {
        "acute_procedure": V.ACUTE_PROCEDURES,
        "routine_procedure": V.ROUTINE_PROCEDURES,
        "transplant": (V.TRANSPLANT,),
        "post_transplant": V.POST_TRANSPLANT,
    }
    mentioned = [f for group in fragments.values() for f in group]
    return (
        rows.filter(F.col(S.ID).isNotNull() & text.rlike("|".join(mentioned)))
        .select(S.ID, S.ADMISSION, *[text.rlike("|".join(group)).cast("int").alias(n) for n, group in fragments.items()])
        .groupBy(S.ID, S.ADMISSION)
        .agg(*[F.max(n).alias(n) for n in FLAGS])
    )


def normalised_icd(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    bare = F.replace(F.replace(F.coalesce(code, F.lit("")), F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    return F.upper(bare)


def acute_icd(icd: Column) -> Column:
    """True for acute prefixes and for chapter O numbers in the acute ranges."""
    number = F.substring(icd, 2, 2).try_cast("int")
    in_range = any_of(number.between(low, high) for low, high in V.ACUTE_OBSTETRIC_RANGES)
    return icd.rlike(V.ACUTE_ICD_PATTERN) | F.coalesce(icd.startswith("O") & in_range, F.lit(False))


def unplanned(character: Column, icd: Column, cfg: EpisodeConfig = EpisodeConfig()) -> Column:
    """1 or 0 by ordered rules over the next admission; procedure flags are columns."""
    kind = _folded(F.coalesce(character, F.lit("")), cfg)
    planned_care = (
        any_of(icd.startswith(p) for p in V.DELIVERY_ICD_PREFIXES)
        | (F.col("routine_procedure") == 1)
        | ((F.col("transplant") == 1) & (F.col("post_transplant") == 0))
    )
    return (
        F.when(kind.contains(V.TRANSFER_FRAGMENT), 0)
        .when(acute_icd(icd) | (F.col("acute_procedure") == 1), 1)
        .when(contains_any(kind, V.URGENT_FRAGMENTS) & ~planned_care, 1)
        .otherwise(0)
    )
