"""Dashboard filters: the offered options and one conjunction over the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from episodica import schema as S

CATEGORIES = {
    "sex": "sexo",
    "request_city": "municipiosolicitante",
    "hospital_city": "municipioexecutante",
    "hospital": "executante",
    "specialty": "especialidade",
    "bed": "tipoleito",
    "admission_type": "carater",
    "discharge_reason": "motivoalta",
}
CALENDAR = {"years": "admission_year", "quarters": "admission_quarter", "weekdays": "admission_weekday"}
BOUNDS = {
    "max_previous_hospitalizations": "previous_hospitalizations",
    "max_previous_readmissions": "previous_unplanned_readmissions",
    "max_admissions_last_365d": "admissions_last_365d",
}
DEFAULT_MAX_STAY = 60


@dataclass(frozen=True)
class FilterSpec:
    """Chosen filters. An empty category list keeps everything.

    Calendar lists left at None stand for all observed values; a bound left at
    None stands for the observed maximum. ``max_stay`` counts a missing stay as 0.
    """

    sex: Sequence[str] = ()
    request_city: Sequence[str] = ()
    hospital_city: Sequence[str] = ()
    hospital: Sequence[str] = ()
    specialty: Sequence[str] = ()
    bed: Sequence[str] = ()
    admission_type: Sequence[str] = ()
    discharge_reason: Sequence[str] = ()
    years: Sequence[int] | None = None
    quarters: Sequence[int] | None = None
    weekdays: Sequence[int] | None = None
    readmitted_only: bool = False
    missing_discharge_only: bool = False
    max_stay: int = DEFAULT_MAX_STAY
    max_previous_hospitalizations: int | None = None
    max_previous_readmissions: int | None = None
    max_admissions_last_365d: int | None = None
    # Parameters of the reports behind the filters.
    min_episodes: int = 100
    top_n: int = 20


def _calendar_condition(df: DataFrame, column: str, chosen: Sequence[int] | None) -> Column | None:
    if chosen is None:
        # All observed values: rows without one drop out, unless no row has one.
        observed = df.agg(F.count(column)).scalar()
        return F.col(column).isNotNull() | (observed == 0)
    return F.col(column).isin(*chosen) if chosen else None


def _bound_condition(column: str, bound: int | None) -> Column:
    return F.col(column).isNotNull() if bound is None else F.col(column) <= bound


def apply_filters(df: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Rows that meet every chosen filter."""
    conditions: list[Column | None] = []
    for field, column in CATEGORIES.items():
        chosen = getattr(spec, field)
        conditions.append(F.col(column).isin(*chosen) if chosen else None)
    for field, column in CALENDAR.items():
        conditions.append(_calendar_condition(df, column, getattr(spec, field)))
    if spec.readmitted_only:
        conditions.append(F.col(S.LABEL) == 1)
    if spec.missing_discharge_only:
        conditions.append(F.col(S.DISCHARGE).isNull())
    conditions.append(F.coalesce("length_of_stay_days", F.lit(0)) <= max(1, spec.max_stay))
    for field, column in BOUNDS.items():
        conditions.append(_bound_condition(column, getattr(spec, field)))
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct non-null values of the category and calendar columns, as (field, value) text rows in order.

    One pass: values are unpivoted and made distinct map-side first.
    """
    columns = {**CATEGORIES, **CALENDAR}
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in columns.items()]
    )
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("field", "value")
    )


def filter_maxima(df: DataFrame) -> DataFrame:
    """Upper ends of the four sliders."""
    return df.agg(
        F.greatest(F.lit(1), F.max(F.coalesce("length_of_stay_days", F.lit(0)))).cast("bigint").alias("max_stay"),
        *[F.max(column).cast("bigint").alias(field) for field, column in BOUNDS.items()],
    )
