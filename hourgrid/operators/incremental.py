"""The hourly table and its features, kept up to date by what a day brings.

Sums per grid and hour are additive: the new rows' sums are added to the stored ones of the dates they touch. Features look
back by rows, 47 of them, so each grid's last 47 rows are kept in a table of their own (`tail`). Rows that come after a
grid's last stored hour need only that tail; the history is not read. Grids with a late row are recomputed from their stored
hours, and only up to the 47th row behind the last change.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C
from hourgrid.operators.aggregate import hourly_grid
from hourgrid.operators.series import HISTORY, X, feature_table

LOOK_BACK = HISTORY - 1
SERIES = [*S.KEYS, X, "internet_activity"]  # what features are made of


def merged_hours(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored hourly rows with the sums of new activity added, for the dates of both."""
    parts = stored.select(*S.KEYS, *S.MEASURES).unionByName(hourly_grid(added).select(*S.KEYS, *S.MEASURES))
    sums = parts.groupBy(*S.KEYS).agg(*[F.sum(m).alias(m) for m in S.MEASURES])
    return sums.withColumns(C.total_columns()).withColumn("date", F.to_date("timestamp")).select(*S.HOURLY_COLUMNS)


def changed_spans(added: DataFrame) -> DataFrame:
    """First and last changed hour of each grid that new activity touches."""
    hour = F.date_trunc("hour", "timestamp")
    return added.groupBy("grid_id").agg(F.min(hour).alias("first_change"), F.max(hour).alias("last_change"))


def late_grids(spans: DataFrame, tail: DataFrame) -> DataFrame:
    """Touched grids with a change at or before their last stored hour."""
    last = tail.groupBy("grid_id").agg(F.max("timestamp").alias("_last"))
    return spans.join(last, "grid_id").filter(F.col("first_change") <= F.col("_last")).drop("_last")


def last_rows(series: DataFrame, n: int = LOOK_BACK) -> DataFrame:
    """The last `n` rows of each grid."""
    back = W.partitionBy("grid_id").orderBy(F.desc("timestamp"))
    return series.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n).drop("_back")


def changed_features(series: DataFrame, spans: DataFrame) -> DataFrame:
    """Features of the rows of `series` that the changes in `spans` can have moved.

    `series` has the rows of each grid from `LOOK_BACK` rows before its first change on, or all of them.
    """
    by_time = W.partitionBy("grid_id").orderBy("timestamp")
    features = feature_table(series)
    behind = F.sum((F.col("timestamp") > F.col("last_change")).cast("int")).over(
        by_time.rowsBetween(W.unboundedPreceding, 0))
    moved = series.select(*S.KEYS).join(spans, "grid_id").withColumn("_behind", behind).filter(
        (F.col("timestamp") >= F.col("first_change")) & (F.col("_behind") <= LOOK_BACK))
    keys = moved.select("grid_id", F.col("timestamp").alias("feature_timestamp"))
    return features.join(keys, ["grid_id", "feature_timestamp"], "left_semi")


def replaced_by_key(stored: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Stored rows without those whose key is in `new`, and all of `new`."""
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
