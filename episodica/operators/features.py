"""History features per episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from episodica import schema as S
from episodica.functions.buckets import stay_bucket
from episodica.functions.numeric import round2
from episodica.functions.temporal import days_between, month_start, weekday_sunday0
from episodica.operators.heavy import SLICE, HeavyKeys, cut, history_order, null_safe_key
from episodica.schema import EpisodeConfig

LOOKBACKS = (30, 90, 365)
_TEXT = S.ADMISSION_TEXT


def count_name(days: int) -> str:
    return f"admissions_last_{days}d"


#: Rows of the sweep: an admission arrives, and leaves each look-back frame some days later.
_ARRIVAL, _LEAVING = 0, 1

#: Up to just before the current time; a NULL time reaches from the start to all other NULL times.
_STRICTLY_BEFORE = "range between unbounded preceding and interval '0 00:00:00.000001' day to second preceding"


def history(target: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Row number, previous discharge, previous positives and look-back counts of every episode.

    One sweep along each subject: the admissions of the last n days are those that have arrived before this instant and
    have not left the frame of n days before it. Running sums give all counts in time linear in the rows. Rows without a
    time never leave and count each other.
    """
    if heavy is None:
        return _episodes(_swept(_sweep(target), Window.partitionBy(S.ID), S.ID), target)
    light = _episodes(_swept(_sweep(heavy.without(target, S.ID)), Window.partitionBy(S.ID), S.ID), target)
    return light.unionByName(_episodes(_swept_slices(_sweep(heavy.only(target, S.ID), apart=True), heavy), target))


def history_timeline(target: DataFrame) -> list[DataFrame]:
    """The tables whose rows lie on a subject's timeline: an arrival and a leaving for each look-back."""
    return [target] * (1 + len(LOOKBACKS))


def _sweep(target: DataFrame, apart: bool = False) -> DataFrame:
    """Arrivals with their row, and slim rows for the leavings; told apart by their text where they may have to be cut."""
    arrivals = target.select(
        S.ID,
        F.col(S.ADMISSION).alias("__t"),
        F.lit(_ARRIVAL).alias("__kind"),
        F.lit(0).alias("__back"),
        F.col(_TEXT).alias("__text"),
        F.struct(*[c for c in target.columns if c not in (S.ID, S.ADMISSION, _TEXT)]).alias("__row"),
    )
    timed = target.filter(F.col(S.ADMISSION).isNotNull())
    left = F.explode(
        F.array(*[F.struct((F.col(S.ADMISSION) + F.make_dt_interval(F.lit(d))).alias("t"), F.lit(d).alias("back")) for d in LOOKBACKS])
    )
    text = F.col(_TEXT) if apart else F.lit(None).cast("string")
    leavings = timed.select(S.ID, text.alias("__text"), left.alias("l")).select(
        S.ID, F.col("l.t").alias("__t"), F.lit(_LEAVING).alias("__kind"), F.col("l.back").alias("__back"), "__text"
    )
    return arrivals.unionByName(leavings, allowMissingColumns=True)


def _sweep_order() -> list[Column]:
    time, *rest = history_order("__t", "__text")
    return [time, F.col("__kind").asc(), *rest]


def _arrived() -> Column:
    return F.when(F.col("__kind") == _ARRIVAL, 1).otherwise(0)


def _label() -> Column:
    return F.when(F.col("__kind") == _ARRIVAL, F.coalesce(F.col(f"__row.{S.LABEL}"), F.lit(0))).otherwise(0)


def _inside(days: int) -> Column:
    """What a row adds to the admissions inside a frame."""
    return F.when(F.col("__kind") == _ARRIVAL, 1).when(F.col("__back") == days, -1).otherwise(0)


def _swept(line: DataFrame, subjects: WindowSpec, *by: str) -> DataFrame:
    """Running values before each row; the second window's order is a prefix of the first one's, so one sort serves both."""
    before = subjects.orderBy(*_sweep_order()).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumns({f"__inside{d}": _inside(d) for d in LOOKBACKS})
    discharge = F.when(F.col("__kind") == _ARRIVAL, F.struct(F.col(f"__row.{S.DISCHARGE}").alias("at")))
    return line.withColumns(
        {
            "__n": F.coalesce(F.sum(_arrived()).over(before), F.lit(0)),
            # A struct tells a previous row with no discharge from no previous row.
            "__lag": F.last(discharge, ignorenulls=True).over(before),
            "__sum": F.coalesce(F.sum(_label()).over(before), F.lit(0)),
        }
    ).withColumns(
        {
            f"__c{d}": F.expr(
                f"coalesce(sum(__inside{d}) over (partition by {', '.join(by)} order by __t asc nulls last {_STRICTLY_BEFORE}), 0)"
            )
            for d in LOOKBACKS
        }
    )


def _episodes(swept: DataFrame, target: DataFrame) -> DataFrame:
    own = {S.ID: F.col(S.ID), S.ADMISSION: F.col("__t"), _TEXT: F.col("__text")}
    return swept.filter(F.col("__kind") == _ARRIVAL).select(
        *[own.get(c, F.col(f"__row.{c}")).alias(c) for c in target.columns],
        F.col("__n").cast("bigint").alias("previous_hospitalizations"),
        F.col("__lag.at").alias("previous_discharge_ts"),
        F.col("__sum").cast("bigint").alias("previous_unplanned_readmissions"),
        *[F.col(f"__c{d}").cast("bigint").alias(count_name(d)) for d in LOOKBACKS],
    )


def _swept_slices(line: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """The same sweep, slice by slice.

    A slice starts from the sums of the slices before it. Counts are strict in time: if a slice begins at the instant at
    which the one before ends, its first instant must not see what the slices before hold of it, the tail.
    """
    slices = cut(line.withColumn("__key", null_safe_key(S.ID)), "__key", _sweep_order(), heavy)
    rows = _swept(slices.rows, Window.partitionBy("__key", SLICE), "__key", SLICE)

    ordered = F.struct(F.col("__t").isNull(), "__t", "__kind", F.when(F.col("__t").isNull(), F.md5("__text")), "__text")
    arrival = F.col("__kind") == _ARRIVAL
    totals = rows.groupBy("__key", SLICE).agg(
        F.sum(_arrived()).alias("n"),
        F.sum(_label()).alias("sum"),
        F.max(F.when(arrival, F.struct(ordered, F.struct(F.col(f"__row.{S.DISCHARGE}").alias("at")))))["col2"].alias("lag"),
        F.count_if(arrival & F.col("__t").isNull()).alias("untimed"),
        F.min("__t").alias("first"),
        F.max("__t").alias("last"),
        *[F.sum(f"__inside{d}").alias(f"c{d}") for d in LOOKBACKS],
        # Of the rows at the last instant any tells what lies before it.
        *[F.max_by(f"__c{d}", "__t").alias(f"head{d}") for d in LOOKBACKS],
        *[F.sum(F.when(F.col("__t").isNull(), F.col(f"__inside{d}")).otherwise(0)).alias(f"null{d}") for d in LOOKBACKS],
    )
    chain = Window.partitionBy("__key", "last").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumns(
        {f"tail{d}": F.sum(F.col(f"c{d}") - F.col(f"head{d}") - F.col(f"null{d}")).over(chain) for d in LOOKBACKS}
    )
    along, earlier = slices.along(), slices.earlier()
    shared = F.coalesce(F.lag("last").over(along) == F.col("first"), F.lit(False))
    state = totals.select(
        "__key",
        SLICE,
        F.col("first").alias("__first"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("__sum0"),
        F.last("lag", ignorenulls=True).over(earlier).alias("__lag0"),
        F.sum("untimed").over(Window.partitionBy("__key")).alias("__untimed"),
        *[F.coalesce(F.sum(f"c{d}").over(earlier), F.lit(0)).alias(f"__before{d}") for d in LOOKBACKS],
        *[F.when(shared, F.lag(f"tail{d}").over(along)).otherwise(0).alias(f"__tail{d}") for d in LOOKBACKS],
    )
    joined = slices.with_state(rows, state)
    at_first = F.col("__t") == F.col("__first")
    return joined.withColumns(
        {
            "__n": F.col("__n") + F.col("__n0"),
            "__lag": F.coalesce("__lag", "__lag0"),
            "__sum": F.col("__sum") + F.col("__sum0"),
            **{
                f"__c{d}": F.when(F.col("__t").isNull(), F.col("__untimed"))
                .when(at_first, F.col(f"__before{d}") - F.col(f"__tail{d}"))
                .otherwise(F.col(f"__c{d}") + F.col(f"__before{d}"))
                for d in LOOKBACKS
            },
        }
    )


def build_features(
    target: DataFrame, cfg: EpisodeConfig = EpisodeConfig(), heavy: HeavyKeys | None = None
) -> DataFrame:
    """The feature table: history over all episodes, then eligible ones only."""
    rows = history(
        target.select(S.ID, _TEXT, *cfg.attributes, S.ADMISSION, S.DISCHARGE, S.ELIGIBLE, S.LABEL), heavy
    )
    return rows.filter(F.col(S.ELIGIBLE) == 1).select(
        S.ID,
        *cfg.attributes,
        S.ADMISSION,
        S.DISCHARGE,
        days_between(S.ADMISSION, S.DISCHARGE).alias("length_of_stay_days"),
        "previous_hospitalizations",
        "previous_unplanned_readmissions",
        *[count_name(d) for d in LOOKBACKS],
        days_between("previous_discharge_ts", S.ADMISSION).alias("days_since_previous_hospitalization"),
        month_start(S.ADMISSION).alias("admission_month"),
        F.year(S.ADMISSION).cast("bigint").alias("admission_year"),
        F.quarter(S.ADMISSION).cast("bigint").alias("admission_quarter"),
        weekday_sunday0(S.ADMISSION).alias("admission_weekday"),
        stay_bucket(days_between(S.ADMISSION, S.DISCHARGE)).alias("los_bucket"),
        F.col(S.LABEL).cast("int").alias(S.LABEL),
    )


def check_features(target: DataFrame, features: DataFrame) -> None:
    """Raise when eligible episodes and feature rows differ in number."""
    expected = target.filter(F.col(S.ELIGIBLE) == 1).count()
    found = features.count()
    if expected != found:
        raise ValueError(f"Eligible episode count changed: {expected:,} -> {found:,}")


def feature_invariants(target: DataFrame, features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("feature_rows")).select(
        target.filter(F.col(S.ELIGIBLE) == 1).agg(F.count(F.lit(1))).scalar().alias("eligible_episodes"),
        "feature_rows",
    )


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum(S.LABEL).cast("bigint").alias("unplanned_readmissions"),
        round2(F.avg(S.LABEL) * 100).alias("unplanned_readmission_rate"),
        round2(F.avg("length_of_stay_days")).alias("avg_length_of_stay_days"),
    )
