"""Rule alerts against within-day leave-one-out medians."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C
from hourgrid.functions.quantiles import exact_percentile, leave_one_out_median
from hourgrid.operators.series import previous_row

X = "total_activity"
# Day totals are added up in two places; rounding makes the two agree to the last bit.
DAY_SCALE = 6


def activity_floor(hourly: DataFrame, share: float = S.FLOOR_PERCENTILE) -> DataFrame:
    """One row: the exact percentile of total activity over grid days."""
    days = hourly.groupBy("grid_id", "date").agg(F.round(F.sum(X), DAY_SCALE).alias("_day"))
    return exact_percentile(days, "_day", share, "activity_floor")


def with_daily_total(hourly: DataFrame) -> DataFrame:
    """The grid's total of the day on every row of it: a window, not a join back."""
    day = W.partitionBy("grid_id", "date")
    return hourly.withColumn("daily_total_activity", F.round(F.sum(X).over(day), DAY_SCALE))


def above_floor_rows(hourly: DataFrame, floor: Column | float | None = None) -> DataFrame:
    floor = activity_floor(hourly).scalar() if floor is None else floor
    return with_daily_total(hourly).withColumn(
        "above_activity_floor", F.col("daily_total_activity") >= floor
    )


def day_baseline(hourly: DataFrame) -> DataFrame:
    return leave_one_out_median(hourly, ["grid_id", "date"], X, "baseline_activity")


# The texts stored with alerts.
REASONS = {
    "HIGH_ACTIVITY": "Current activity %.2f is at least %.2fx the within-day baseline %.2f.",
    "ACTIVITY_SPIKE": "Activity increased from %.2f to %.2f, at least %.2fx the previous hour.",
    "ACTIVITY_DROP": "Current activity %.2f is at or below %.2fx the within-day baseline %.2f.",
}


def rule_alerts(hourly: DataFrame, floor: Column | float | None = None) -> DataFrame:
    """One row per rule that fires; several rules may fire for the same grid and hour.

    The previous-row window comes first: it lays rows out by grid, and the windows by
    grid and day that follow need no further exchange.
    """
    return fired_rules(day_baseline(above_floor_rows(previous_row(hourly), floor)))


def fired_rules(scored: DataFrame) -> DataFrame:
    """The alerts of rows that know their previous activity, day baseline and whether their day is above the floor."""
    current, before, base = F.col(X), F.col("previous_activity"), F.col("baseline_activity")
    fires = {
        "HIGH_ACTIVITY": current >= base * S.HIGH_MULTIPLIER,
        "ACTIVITY_SPIKE": (before > 0) & (current >= before * S.SPIKE_MULTIPLIER),
        "ACTIVITY_DROP": current <= base * S.DROP_MULTIPLIER,
    }
    fired = F.array_compact(F.array(*[F.when(fires[t], F.lit(t)) for t in S.ALERT_TYPES]))
    # The text is made after the rows that fire nothing are gone, and only if it is read.
    return (
        scored.filter(F.col("above_activity_floor") & base.isNotNull())
        .select(*S.KEYS, current.alias("current_activity"), base, "previous_activity",
                F.explode(fired).alias("alert_type"))
        .select(*S.KEYS, "alert_type", "current_activity", "baseline_activity",
                _reason().alias("reason"))
    )


def _reason() -> Column:
    now, before, base = (F.col(c) for c in ("current_activity", "previous_activity", "baseline_activity"))
    values = {
        "HIGH_ACTIVITY": (now, F.lit(S.HIGH_MULTIPLIER), base),
        "ACTIVITY_SPIKE": (before, now, F.lit(S.SPIKE_MULTIPLIER)),
        "ACTIVITY_DROP": (now, F.lit(S.DROP_MULTIPLIER), base),
    }
    texts = {kind: F.format_string(REASONS[kind], *values[kind]) for kind in REASONS}
    return reduce(lambda acc, kv: acc.when(F.col("alert_type") == kv[0], kv[1]), texts.items(), F)


def alert_keys(alerts: DataFrame) -> DataFrame:
    """Grid hours with at least one alert."""
    return alerts.select(*S.KEYS).distinct()


def alert_summary(alerts: DataFrame, hourly: DataFrame) -> DataFrame:
    """Alerts, distinct alerting grid hours and their share of all grid hours."""
    grid_hours = hourly.agg(F.count(F.lit(1)).alias("n")).scalar()
    return alerts.groupBy(*S.KEYS).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("alerts"),
        F.count(F.lit(1)).alias("alerting_grid_hours"),
    ).withColumn("grid_hours", grid_hours).withColumn(
        "alerting_rate", C.safe_ratio(F.col("alerting_grid_hours"), F.col("grid_hours"))
    )


def top_alerting_grids(alerts: DataFrame, k=10) -> DataFrame:
    counts = alerts.groupBy("grid_id").agg(F.count(F.lit(1)).alias("alerts"))
    return counts.orderBy(F.desc("alerts"), F.asc("grid_id")).limit(k)


def latest_per_grid(alerts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Last alert of each grid up to `as_of`; at equal times the earlier rule wins."""
    seen = alerts if as_of is None else alerts.filter(F.col("timestamp") <= as_of)
    order = F.struct(F.col("timestamp"), -C.rank_in(F.col("alert_type"), S.ALERT_TYPES))
    rest = [c for c in alerts.columns if c != "grid_id"]
    last = seen.groupBy("grid_id").agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select("grid_id", "_last.*")
