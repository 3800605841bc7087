"""Profiles of parsed activity; each is one pass with partial aggregation."""

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid import schema as S


def dataset_profile(parsed: DataFrame, file_column=None, approximate=False) -> DataFrame:
    """Rows, distinct files, grids, countries and hourly intervals."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    counts = [
        F.count(F.lit(1)).alias("rows"),
        distinct(F.col("grid_id")).alias("grids"),
        distinct(F.col("country_code")).alias("countries"),
        distinct(F.date_trunc("hour", "timestamp")).alias("hours"),
    ]
    if file_column:
        counts.append(distinct(F.col(file_column)).alias("files"))
    return parsed.agg(*counts)


def null_profile(df: DataFrame, names) -> DataFrame:
    """NULLs per column and their grand total, one row."""
    counts = [F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in names]
    total = reduce(lambda a, b: a + b, [F.col(f"null_{n}") for n in names])
    return df.agg(*counts).withColumn("null_total", total)


def negative_profile(df: DataFrame, names=S.MEASURES) -> DataFrame:
    return df.agg(*[F.count_if(F.col(n) < 0).alias(f"negative_{n}") for n in names])


def duplicate_rows(df: DataFrame, names=None) -> DataFrame:
    """Number of exact repeats beyond the first. Copies meet already on the map side."""
    groups = df.groupBy(*(names or df.columns)).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def frequencies(df: DataFrame, name: str, count_name="rows") -> DataFrame:
    return (
        df.groupBy(name).agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.desc(count_name), F.asc(name))
    )


def rows_at(df: DataFrame, timestamp, grid_id) -> DataFrame:
    """The rows of one grid at one time; both may be scalar subquery columns."""
    return df.filter((F.col("timestamp") == timestamp) & (F.col("grid_id") == grid_id))


def country_rows(parsed: DataFrame) -> DataFrame:
    """Source rows per grid and hour, before countries are summed away."""
    return parsed.groupBy("grid_id", F.date_trunc("hour", "timestamp").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("country_rows")
    )


def cadence_gaps(df: DataFrame) -> DataFrame:
    """How often each gap, in hours, occurs between successive distinct hours."""
    hours = df.select(F.date_trunc("hour", "timestamp").alias("timestamp")).distinct()
    # One row per calendar hour of the data, so the single ordered pass is small.
    previous = F.lag("timestamp").over(W.orderBy("timestamp"))
    gap = (F.unix_timestamp("timestamp") - F.unix_timestamp(previous)) / 3600.0
    return (
        hours.select(gap.alias("gap_hours")).filter("gap_hours IS NOT NULL")
        .groupBy("gap_hours").agg(F.count(F.lit(1)).alias("gaps"))
    )


def cadence_check(df: DataFrame) -> DataFrame:
    """Distinct hours against distinct days times 24."""
    return df.agg(
        F.count_distinct(F.date_trunc("hour", "timestamp")).alias("hours"),
        F.count_distinct(F.to_date("timestamp")).alias("days"),
    ).withColumns({
        "expected_hours": F.col("days") * 24,
        "complete": F.col("hours") == F.col("days") * 24,
    })
