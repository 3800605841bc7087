"""Time-series operators on the hourly table.

The hourly table is unique by (grid_id, timestamp), so a window partition of one grid
holds at most one row per hour of the calendar span (8,784 a year), however many raw
rows the grid had. All windows below share one ordering, hence one exchange and one sort.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C
from hourgrid.functions.quantiles import median_of_sorted, rolling_middle
from hourgrid.operators.clean import protect_features

HOUR = 3600
X = "total_activity"


def by_time():
    return W.partitionBy("grid_id").orderBy("timestamp")


def previous_row(hourly: DataFrame) -> DataFrame:
    return hourly.withColumn("previous_activity", F.lag(X).over(by_time()))


def relative_change(current: Column, previous: Column) -> Column:
    """Change against the previous value; 0.0 unless that value is above zero."""
    return F.when(previous > 0, (current - previous) / previous).otherwise(F.lit(0.0))


def activity_change(hourly: DataFrame) -> DataFrame:
    now, before = F.col(X), F.col("previous_activity")
    return previous_row(hourly).withColumns({
        "activity_change": now - before,
        "activity_change_pct": relative_change(now, before),
    })


# A window expression is evaluated again for every place it is written in. So the
# operators below first list what they need from the windows, each once under a private
# name, and derive their columns from those names in a second projection.

def _mean_parts(sizes) -> dict[str, Column]:
    spec = by_time()
    return {f"_mean{n}": F.avg(X).over(spec.rowsBetween(-(n - 1), 0)) for n in sizes}


def _mean(n: int) -> Column:
    return F.when(F.col("_row") >= n, F.col(f"_mean{n}"))


def _row_part() -> dict[str, Column]:
    return {"_row": F.row_number().over(by_time())}


def _temporal_parts() -> dict[str, Column]:
    return {**_mean_parts((3, 6, 24)), "_before": F.lag(X).over(by_time())}


def _temporal() -> dict[str, Column]:
    now, before = F.col(X), F.col("_before")
    return {
        "current_activity": now,
        "previous_hour_activity": before,
        "rolling_3h_activity": _mean(3),
        "rolling_6h_activity": _mean(6),
        "rolling_24h_activity": _mean(24),
        "activity_change": now - before,
        "activity_change_pct": relative_change(now, before),
    }


def _window_parts() -> dict[str, Column]:
    spec = by_time()
    recent = spec.rowsBetween(-(S.RECENT_ROWS - 1), 0)
    past = spec.rowsBetween(-(S.RECENT_ROWS + S.BASELINE_ROWS - 1), -S.RECENT_ROWS)
    return {
        f"_mean{S.RECENT_ROWS}": F.avg(X).over(recent),
        "_past_mean": F.avg(X).over(past),
        "_active": F.count_if(F.col(X) > 0).over(recent),
        "_most": F.max(X).over(recent),
        "_spread": F.stddev_pop(X).over(recent),
        "_internet": F.sum("internet_activity").over(recent),
        "_total": F.sum(X).over(recent),
    }


def _windowed() -> dict[str, Column]:
    mean, past_mean = F.col(f"_mean{S.RECENT_ROWS}"), F.col("_past_mean")
    return {
        "avg_activity": mean,
        "activity_growth": C.safe_ratio(mean - past_mean, past_mean),
        "active_hours": F.col("_active"),
        "peak_ratio": C.safe_ratio(F.col("_most"), mean),
        "variability": F.col("_spread"),
        "internet_share": C.safe_ratio(F.col("_internet"), F.col("_total")),
    }


def _derived(hourly: DataFrame, parts: dict, columns: dict, min_row=1) -> DataFrame:
    """Key columns and `columns`, from `parts` of one pass over each grid's series."""
    passed = hourly.select(*S.KEYS, X, *[c.alias(n) for n, c in {**_row_part(), **parts}.items()])
    return passed.filter(F.col("_row") >= min_row).select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"),
        *[c.alias(n) for n, c in columns.items()],
    )


def rolling_means(hourly: DataFrame, sizes=(3, 6, 24)) -> DataFrame:
    """Means of the last rows; NULL until there are that many."""
    marked = hourly.withColumns({**_row_part(), **_mean_parts(sizes)})
    return marked.withColumns({f"rolling_{n}h_activity": _mean(n) for n in sizes}).drop(
        "_row", *[f"_mean{n}" for n in sizes]
    )


def rolling_baseline(hourly: DataFrame, rows: int = S.BASELINE_ROWS) -> DataFrame:
    """Rolling median per grid and the threshold above which the next hour is high."""
    return (
        hourly.withColumn("_sorted", rolling_middle(X, rows, by_time()))
        .withColumn("baseline_activity", median_of_sorted(F.col("_sorted"), rows)).drop("_sorted")
        .withColumn("high_activity_threshold", F.col("baseline_activity") * S.HIGH_MULTIPLIER)
    )


def temporal_features(hourly: DataFrame) -> DataFrame:
    """Current, previous and rolling values known at each feature time."""
    return _derived(hourly, _temporal_parts(), _temporal())


HISTORY = S.RECENT_ROWS + S.BASELINE_ROWS


def feature_windows(hourly: DataFrame) -> DataFrame:
    """Last 24 rows against the 24 before them; from the 48th row of a grid on."""
    rows = _derived(hourly, _window_parts(), _windowed(), HISTORY)
    return protect_features(rows, S.WINDOW_FEATURES)


def feature_table(hourly: DataFrame) -> DataFrame:
    """Window and temporal features together, from a single pass over the series."""
    parts = {**_temporal_parts(), **_window_parts()}
    rows = _derived(hourly, parts, {**_windowed(), **_temporal()}, HISTORY)
    return protect_features(rows, S.WINDOW_FEATURES)


def feature_table_with_label(hourly: DataFrame) -> DataFrame:
    """`feature_table` plus the next-hour label, still one exchange and no join.

    Hours are unique per grid, so the row at t+1h, if there is one, is the next row.
    Rows without that hour or without a full rolling median are dropped.
    """
    spec = by_time()
    parts = {
        **_temporal_parts(), **_window_parts(),
        "_next_time": F.lead("timestamp").over(spec),
        "_next": F.lead(X).over(spec),
        "_sorted": rolling_middle(X, S.BASELINE_ROWS, spec),
    }
    exact = F.col("_next_time") == F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    baseline = median_of_sorted(F.col("_sorted"), S.BASELINE_ROWS)
    rows = _derived(hourly, parts, {
        **_windowed(), **_temporal(),
        "future_total_activity": F.when(exact, F.col("_next")),
        "baseline_activity": baseline,
        "high_activity_threshold": baseline * S.HIGH_MULTIPLIER,
    }, HISTORY)
    return _labelled(protect_features(rows, S.WINDOW_FEATURES))


def _labelled(rows: DataFrame) -> DataFrame:
    high = F.col("future_total_activity") > F.col("high_activity_threshold")
    return rows.dropna(
        subset=["future_total_activity", "baseline_activity", "high_activity_threshold"]
    ).withColumns({
        "HIGH_ACTIVITY": high.cast("int"),
        "prediction_timestamp": F.col("feature_timestamp") + F.expr("INTERVAL 1 HOUR"),
    })


def next_hour_label(features: DataFrame, hourly: DataFrame) -> DataFrame:
    """Label for a stored feature table: activity shifted back by an hour, joined on time."""
    baseline = rolling_baseline(hourly).select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"),
        "baseline_activity", "high_activity_threshold",
    )
    future = hourly.select(
        "grid_id",
        (F.col("timestamp") - F.expr("INTERVAL 1 HOUR")).alias("feature_timestamp"),
        F.col(X).alias("future_total_activity"),
    )
    keys = ["grid_id", "feature_timestamp"]
    return _labelled(features.join(baseline, keys).join(future, keys))


def join_features(windowed: DataFrame, temporal: DataFrame, how="inner") -> DataFrame:
    """Window features with temporal features of the same grid and hour."""
    return windowed.join(temporal, ["grid_id", "feature_timestamp"], how)


def hour_range_features(hourly: DataFrame) -> DataFrame:
    """Exact-hour form: means over t-2h..t and t-5h..t, previous value at exactly t-1h or 0."""
    by_second = W.partitionBy("grid_id").orderBy(F.unix_timestamp("timestamp"))

    def over_hours(first, last):
        return by_second.rangeBetween(-first * HOUR, -last * HOUR)

    rows = hourly.select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"),
        F.col(X).alias("current_activity"),
        F.max(X).over(over_hours(1, 1)).alias("_before"),
        F.avg(X).over(over_hours(2, 0)).alias("rolling_3h_activity"),
        F.avg(X).over(over_hours(5, 0)).alias("rolling_6h_activity"),
    ).withColumn("previous_hour_activity", F.coalesce("_before", F.lit(0.0))).drop("_before")
    change = F.col("current_activity") - F.col("previous_hour_activity")
    return rows.withColumns({
        "activity_change": change,
        "activity_change_pct": C.safe_ratio(change, F.col("previous_hour_activity")),
    })


def trailing_mean(days: int = 7, value: str = X, time: str = "timestamp") -> Column:
    """Mean strictly between t - `days` and t; NULL where nothing lies there."""
    spec = W.partitionBy("grid_id").orderBy(F.unix_timestamp(time))
    return F.avg(value).over(spec.rangeBetween(-(days * 24 * HOUR - 1), -1))


def trailing_7d_mean(hourly: DataFrame) -> DataFrame:
    return hourly.withColumn("mean_7d", trailing_mean())


def next_hour_gap(hourly: DataFrame) -> DataFrame:
    """The next row's time and whether it is exactly one hour later."""
    following = F.lead("timestamp").over(by_time())
    return hourly.select(*S.KEYS, following.alias("next_timestamp")).withColumn(
        "exact_next_hour",
        F.coalesce(
            F.col("next_timestamp") == F.col("timestamp") + F.expr("INTERVAL 1 HOUR"),
            F.lit(False),
        ),
    )
