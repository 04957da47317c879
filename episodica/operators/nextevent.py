"""Forward as-of match: for each row, the subject's first event strictly after the row's end.

Rows ("queries", at their end) and events (at their start) are laid on one
timeline per subject and read from late to early; the last event seen before a
query is the first one after it in time. That costs one exchange and one sort,
and the query's payload is shuffled once. Flags known per (subject, time) ride
on the same timeline, so they reach the event without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from episodica.operators.heavy import SLICE, HeavyKeys, Slices, cut, null_safe_key

_QUERY, _SIGNAL, _EVENT = 0, 1, 2


def next_event(
    episodes: DataFrame,
    *,
    key: str,
    start: str,
    end: str,
    tie: str,
    next_start: str,
    carry: Mapping[str, str],
    signals: DataFrame | None = None,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Add ``next_start`` and the ``carry`` columns (source name -> new name) of the next event.

    Events at one instant are told apart by the smallest ``tie``. Rows without
    an end or a key match nothing and take no part in the exchange. ``signals``
    has one row per (key, start) with integer flag columns; the flags of the
    next event come back under their own names, 0 where there are none.
    """
    flags = [c for c in signals.columns if c not in (key, start)] if signals is not None else []
    matchable = F.col(key).isNotNull() & F.col(end).isNotNull()

    def timeline(part: DataFrame, part_signals: DataFrame | None) -> DataFrame:
        return _timeline(part, part_signals, key, start, end, tie, carry, flags)

    def answers(matched: DataFrame) -> DataFrame:
        own = {key: F.col(key), end: F.col("__t")}
        return matched.filter(F.col("__kind") == _QUERY).select(
            *[own.get(c, F.col(f"__row.{c}")).alias(c) for c in episodes.columns],
            F.col("__next.start").alias(next_start),
            *[F.col(f"__next.{source}").alias(name) for source, name in carry.items()],
            *[F.coalesce(F.col(f"__next.{flag}"), F.lit(0)).alias(flag) for flag in flags],
        )

    if heavy is None:
        found = answers(_match(timeline(episodes, signals), key, flags))
    else:
        light = heavy.without(signals, key) if signals is not None else None
        dense = heavy.only(signals, key) if signals is not None else None
        line = timeline(heavy.only(episodes, key), dense)
        # Queries and signals of one instant are told apart too, so that a burst of them can be cut.
        apart = F.coalesce("__tie", F.col(f"__row.{tie}")) if tie not in (key, end) else F.col("__tie")
        slices = cut(line, key, [*_late_to_early(), apart.desc_nulls_last()], heavy)
        found = answers(_match(timeline(heavy.without(episodes, key), light), key, flags)).unionByName(
            answers(_match_slices(slices, flags))
        )

    types = {f.name: f.dataType for f in episodes.schema}
    unmatched = episodes.filter(~matchable).select(
        "*",
        F.lit(None).cast(types[start]).alias(next_start),
        *[F.lit(None).cast(types[source]).alias(name) for source, name in carry.items()],
        *[F.lit(0).alias(flag) for flag in flags],
    )
    return found.unionByName(unmatched)


def _timeline(
    episodes: DataFrame,
    signals: DataFrame | None,
    key: str,
    start: str,
    end: str,
    tie: str,
    carry: Mapping[str, str],
    flags: Sequence[str],
) -> DataFrame:
    event = F.struct(F.col(start).alias("start"), *[F.col(c) for c in carry])
    queries = episodes.filter(F.col(key).isNotNull() & F.col(end).isNotNull()).select(
        key,
        F.col(end).alias("__t"),
        F.lit(_QUERY).alias("__kind"),
        # Key and end travel as the timeline's own columns.
        F.struct(*[c for c in episodes.columns if c not in (key, end)]).alias("__row"),
    )
    events = episodes.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        key,
        F.col(start).alias("__t"),
        F.lit(_EVENT).alias("__kind"),
        F.col(tie).alias("__tie"),
        event.alias("__event"),
    )
    line = queries.unionByName(events, allowMissingColumns=True)
    if signals is not None:
        # Signals without a time sort behind everything and meet no event.
        marks = signals.filter(F.col(key).isNotNull()).select(
            key,
            F.col(start).alias("__t"),
            F.lit(_SIGNAL).alias("__kind"),
            F.struct(F.col(start).alias("at"), *flags).alias("__signal"),
        )
        line = line.unionByName(marks, allowMissingColumns=True)
    return line


def _late_to_early() -> list[Column]:
    """At one instant queries come first, so an event there is not later. A signal stands right before the events of its
    instant, so the last one seen is theirs or none is."""
    return [F.col("__t").desc(), F.col("__kind").asc(), F.col("__tie").desc_nulls_last()]


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _flagged(line: DataFrame, seen: Column, flags: Sequence[str]) -> DataFrame:
    """Events with the flags of the signal at their instant."""
    line = line.withColumn("__seen", F.when(seen["at"] == F.col("__t"), seen))
    fields = [f.name for f in line.schema["__event"].dataType.fields]
    flagged = F.struct(
        *[F.col(f"__event.{f}").alias(f) for f in fields], *[F.col(f"__seen.{f}").alias(f) for f in flags]
    )
    return line.withColumn("__event", F.when(F.col("__kind") == _EVENT, flagged))


def _match(line: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Read each subject from late to early."""
    earlier_rows = _before(Window.partitionBy(key).orderBy(*_late_to_early()))
    if flags:
        line = _flagged(line, F.last("__signal", ignorenulls=True).over(earlier_rows), flags)
    return line.withColumn("__next", F.last("__event", ignorenulls=True).over(earlier_rows))


def _match_slices(slices: Slices, flags: Sequence[str]) -> DataFrame:
    """The same, slice by slice: the last signal and the last event of the slices before are carried on.

    A cut may fall between a signal and the events of its instant, so signals are carried before events take their flags.
    """
    line, by = slices.rows, [slices.key, SLICE]
    earlier_rows = _before(slices.window(*_late_to_early()))
    if flags:
        signal = F.when((F.col("__kind") == _SIGNAL) & F.col("__t").isNotNull(), F.col("__signal"))
        last = line.groupBy(*by).agg(F.min(signal).alias("last"))
        state = last.select(*by, F.last("last", ignorenulls=True).over(slices.earlier()).alias("__carried_signal"))
        line = line.withColumn("__seen_here", F.last("__signal", ignorenulls=True).over(earlier_rows))
        line = slices.with_state(line, state)
        line = _flagged(line, F.coalesce("__seen_here", "__carried_signal"), flags)
    line = line.withColumn("__next", F.last("__event", ignorenulls=True).over(earlier_rows))
    event = F.when(F.col("__kind") == _EVENT, F.struct("__t", "__tie", F.col("__event").alias("event")))
    last = line.groupBy(*by).agg(F.min(event).alias("last"))
    state = last.select(*by, F.last("last", ignorenulls=True).over(slices.earlier())["event"].alias("__carried"))
    return slices.with_state(line, state).withColumn("__next", F.coalesce("__next", "__carried"))


def lead_row(
    df: DataFrame,
    *,
    key: str,
    order: Sequence[Column],
    columns: Mapping[str, str],
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Columns of the subject's next row in ``order`` (source name -> new name), one window for all of them."""
    payload = F.struct(*columns)

    def expand(part: DataFrame) -> DataFrame:
        return part.select(*df.columns, *[F.col(f"__lead.{c}").alias(name) for c, name in columns.items()])

    def plain(part: DataFrame) -> DataFrame:
        return expand(part.withColumn("__lead", F.lead(payload).over(Window.partitionBy(key).orderBy(*order))))

    if heavy is None:
        return plain(df)

    # The last row of a slice is followed by the first one of the next.
    slices = cut(heavy.only(df, key).withColumn("__key", null_safe_key(key)), "__key", order, heavy)
    in_slice = slices.window(*order)
    rows = slices.rows.withColumn("__lead", F.lead(payload).over(in_slice)).withColumn("__place", F.row_number().over(in_slice))
    firsts = rows.filter(F.col("__place") == 1).select("__key", SLICE, payload.alias("first"))
    state = firsts.select("__key", SLICE, F.lead("first").over(slices.along()).alias("__carried"))
    dense = slices.with_state(rows, state).withColumn("__lead", F.coalesce("__lead", "__carried"))
    return plain(heavy.without(df, key)).unionByName(expand(dense))
