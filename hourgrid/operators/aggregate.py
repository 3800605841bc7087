"""Grid, hour and day summaries.

Everything starts from `hourly_grid`, the only shuffle of raw rows. It adds up on the
map side first, so a grid holding a large share of the raw rows sends one partial sum
per task and hour. Its result is unique by (grid_id, timestamp); later operators read it.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C


def hourly_grid(activity: DataFrame, null_mode="zero", scale=None) -> DataFrame:
    """Sums of the five measures by grid and hour, countries summed away.

    `null_mode="propagate"` leaves a sum NULL when the whole group is. `scale` rounds
    the sums, which makes them independent of the order of addition.
    """
    if null_mode not in ("zero", "propagate"):
        raise ValueError(f"unknown null mode {null_mode!r}")

    def total(m):
        value = F.coalesce(F.col(m), F.lit(0.0)) if null_mode == "zero" else F.col(m)
        return C.rounded(F.sum(value), scale).alias(m)

    sums = activity.groupBy(
        "grid_id", F.date_trunc("hour", "timestamp").alias("timestamp")
    ).agg(*[total(m) for m in S.MEASURES])
    return sums.withColumns(C.total_columns(scale)).withColumn("date", F.to_date("timestamp"))


def geometry_free(hourly: DataFrame) -> DataFrame:
    """The analytics projection; refuses a frame that carries geometry."""
    if "geometry" in hourly.columns:
        raise ValueError("the analytics table must not carry geometry")
    return hourly.select(*S.HOURLY_COLUMNS)


def _sums(*names):
    return [F.sum(n).alias(n) for n in names]


def daily_kpi(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(
        *_sums("total_sms", "total_calls", "internet_activity", "total_activity"),
        F.count_distinct("grid_id").alias("active_grids"),
    )


def grid_kpi(hourly: DataFrame) -> DataFrame:
    sums = hourly.groupBy("grid_id").agg(
        *_sums("total_sms", "total_calls", "internet_activity", "total_activity")
    )
    return sums.orderBy(F.desc("total_activity"), F.asc("grid_id"))


def daily_traffic(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date", "grid_id").agg(
        *_sums("total_sms", "total_calls", "internet_activity", "total_activity")
    )


def dashboard_totals(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(
        *_sums("total_sms", "total_calls", "internet_activity", "total_activity")
    ).orderBy("date")


def dashboard_measures(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(*_sums(*S.MEASURES, "total_activity")).orderBy("date")


def peak_hour_of_day(hourly: DataFrame) -> DataFrame:
    by_hour = hourly.groupBy(F.hour("timestamp").alias("hour")).agg(*_sums("total_activity"))
    return by_hour.orderBy(F.desc("total_activity"), F.asc("hour")).limit(1)


def internet_share(hourly: DataFrame) -> DataFrame:
    return hourly.agg(*_sums("internet_activity", "total_activity")).withColumn(
        "internet_percent",
        C.safe_ratio(F.col("internet_activity"), F.col("total_activity")) * 100,
    )


def busiest_hours(hourly: DataFrame, k=1) -> DataFrame:
    by_time = hourly.groupBy("timestamp").agg(*_sums("total_activity"))
    return by_time.orderBy(F.desc("total_activity"), F.asc("timestamp")).limit(k)


def busiest_grids(hourly: DataFrame, k=1) -> DataFrame:
    by_grid = hourly.groupBy("grid_id").agg(*_sums("total_activity"))
    return by_grid.orderBy(F.desc("total_activity"), F.asc("grid_id")).limit(k)


def hotspots_from_days(hourly: DataFrame, k=10) -> DataFrame:
    """Top grids from the daily totals; the day level is reused when it is stored."""
    by_grid = daily_traffic(hourly).groupBy("grid_id").agg(*_sums("total_activity"))
    return by_grid.orderBy(F.desc("total_activity"), F.asc("grid_id")).limit(k)


def grid_days(hourly: DataFrame) -> DataFrame:
    """Distinct days on which each grid has points."""
    return hourly.select("grid_id", "date").distinct()


def first_grids(df: DataFrame, k=5) -> DataFrame:
    """The k lowest grid ids in numeric order."""
    number = F.col("grid_id").try_cast("bigint")
    return df.select("grid_id").distinct().orderBy(number, "grid_id").limit(k)


def union_days(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Processed days stacked by column name; a column missing in one frame is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def duplicate_keys(df: DataFrame, keys=S.KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def grain_check(df: DataFrame, keys=S.KEYS) -> DataFrame:
    """Rows, keys and keys that occur more than once."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
    ).withColumn("passed", F.col("duplicate_keys") == 0)


def grain_bounds(activity: DataFrame, hourly: DataFrame, n_cells=S.N_CELLS) -> DataFrame:
    """Row reduction of the hourly step and the largest grain the calendar allows."""
    raw_rows = activity.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hourly.agg(
        F.count(F.lit(1)).alias("hourly_rows"),
        F.count_distinct("date").alias("days"),
    ).withColumn("raw_rows", raw_rows).withColumns({
        "removed_rows": F.col("raw_rows") - F.col("hourly_rows"),
        "max_rows": F.col("days") * 24 * n_cells,
        "within_bound": F.col("hourly_rows") <= F.col("days") * 24 * n_cells,
    })


def recompute_check(activity: DataFrame, hourly: DataFrame, tolerance=1e-6) -> DataFrame:
    """Every hourly total against a second computation that goes by country first."""
    value = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in S.MEASURES), F.lit(0.0))
    hour = F.date_trunc("hour", "timestamp").alias("timestamp")
    again = (
        activity.groupBy("grid_id", hour, "country_code").agg(F.sum(value).alias("_part"))
        .groupBy("grid_id", "timestamp").agg(F.sum("_part").alias("_again"))
    )
    both = hourly.select(*S.KEYS, "total_activity").join(again, S.KEYS, "full")
    off = F.abs(F.col("total_activity") - F.col("_again")) > tolerance
    return both.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.coalesce(off, F.lit(True))).alias("mismatches"),
    )


def grid_sketches(hourly: DataFrame) -> DataFrame:
    """For each date the grids, counted exactly and as a sketch that merges with those of other dates.

    Pairs of date and grid are made distinct first; beside a distinct count each pair would have a sketch of its own.
    """
    return hourly.select("date", "grid_id").distinct().groupBy("date").agg(
        F.count("grid_id").alias("grids"), F.hll_sketch_agg("grid_id", F.lit(14)).alias("grid_sketch"))


def grids_up_to(sketches: DataFrame) -> DataFrame:
    """Estimated distinct grids from the first date to each date, from the sketches alone: one row a date passes through a task."""
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return sketches.select("date", F.hll_sketch_estimate(F.hll_union_agg("grid_sketch").over(so_far)).alias("grids_so_far"))
