"""Column names of the clinical episode tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from episodica.functions import vocabulary as V

# The column names that input and output tables have.
ID = "identificador"
ADMISSION_TEXT = "datahorainternacao"
DISCHARGE_TEXT = "datahoraalta"
REQUEST_DATE = "datasolicitacao"
ADMISSION = "admission_ts"
DISCHARGE = "discharge_ts"
LABEL = "unplanned_readmitted_30d"
ELIGIBLE = "eligible_for_readmission_model"
DAYS_NEXT = "days_until_next_admission"

# Attributes carried from raw rows to the episode.
ATTRIBUTES = (
    "sexo",
    "municipiosolicitante",
    "municipioresidencia",
    "municipioexecutante",
    "executante",
    "especialidade",
    "tipoleito",
    "carater",
    "codigocid",
    "motivoalta",
)

BILLING_PROCEDURES = (
    "procedimentosolicitado",
    "procprincipalsolicitado",
    "procprincipalautorizado",
    "procedimentosolicitadoeletiva",
)

FEATURE_COUNTS = (
    "previous_hospitalizations",
    "previous_unplanned_readmissions",
    "admissions_last_30d",
    "admissions_last_90d",
    "admissions_last_365d",
)

FEATURE_NUMBERS = (
    "length_of_stay_days",
    "previous_hospitalizations",
    "previous_unplanned_readmissions",
    "days_since_previous_hospitalization",
    "admissions_last_30d",
    "admissions_last_90d",
    "admissions_last_365d",
    "admission_year",
    "admission_quarter",
    "admission_weekday",
)

FEATURE_TIMES = ("admission_ts", "discharge_ts", "admission_month")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Columns the jobs name. Everything is read as text first; casts come later.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "appointments": _strings(ID),
    "regulated_exams": _strings(ID),
    "non_regulated_exams": _strings(ID),
    "requests": _strings(ID),
    "hospitalizations": _strings(
        ID,
        REQUEST_DATE,
        "datahorasolicitacao",
        ADMISSION_TEXT,
        DISCHARGE_TEXT,
        "situacao",
        *ATTRIBUTES,
        "procedimentosolicitado",
    ),
    "billing": _strings(ID, ADMISSION_TEXT, *BILLING_PROCEDURES),
}


@dataclass(frozen=True)
class EpisodeConfig:
    """Choices of the target build; the defaults give the standard label."""

    overrides: tuple[tuple[str, str, str], ...] = V.ADMISSION_OVERRIDES
    year_shifts: tuple[tuple[int, int], ...] = V.YEAR_SHIFTS
    ineligible_reasons: tuple[str, ...] = V.INELIGIBLE_REASONS
    recurrence_days: tuple[int, int] = V.RECURRENCE_DAYS
    raw_recurrence_days: tuple[int, int] = V.RAW_RECURRENCE_DAYS
    # "lexical_max" compares discharge texts; "chronological_max" compares their times.
    discharge_reduce: str = "lexical_max"
    # Match keywords without accents.
    fold_accents: bool = False
    # A subject with more rows than this on its timeline is cut into slices.
    heavy_rows: int = 1_000_000
    attributes: tuple[str, ...] = field(default=ATTRIBUTES)
