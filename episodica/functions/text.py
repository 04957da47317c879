"""Text predicates and small text expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from episodica.functions import vocabulary as V


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, fragments: Iterable[str]) -> Column:
    return any_of(text.contains(f) for f in fragments)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def upper_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.upper(F.coalesce(column, F.lit("")))


def without_accents(text: Column) -> Column:
    """Upper-case text with Portuguese accents removed."""
    return F.translate(text, "ÁÀÂÃÄÉÊÍÓÔÕÖÚÜÇ", "AAAAAEEIOOOOUUC")


def planning_class(character: str | Column) -> Column:
    """Planned, unplanned or undetermined from the admission character; elective wins."""
    text = upper_or_empty(character)
    return (
        F.when(contains_any(text, V.ELECTIVE_FRAGMENTS), V.PLANNED)
        .when(contains_any(text, V.URGENT_FRAGMENTS), V.UNPLANNED)
        .otherwise(V.UNDETERMINED)
    )


def specialty_group(specialty: str | Column) -> Column:
    text = upper_or_empty(specialty)
    chain = F
    for label, fragments in V.SPECIALTY_GROUPS:
        chain = chain.when(contains_any(text, fragments), label)
    return chain.otherwise(V.OTHER_SPECIALTIES)


def distinct_text(column: str | Column, separator: str = " | ") -> Column:
    """Distinct non-null texts joined in order; NULL when there is none."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.array_join(F.array_sort(F.collect_set(column)), separator), F.lit(""))
