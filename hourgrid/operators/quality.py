"""Checks on features, labels and scoring requests."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C

FEATURE_KEYS = ["grid_id", "feature_timestamp"]


def feature_integrity(features: DataFrame, names=None) -> DataFrame:
    """Rows, duplicate keys and unusable values per feature, in one pass over the keys."""
    names = [n for n in (names or S.MODEL_FEATURES) if n in features.columns]

    def unusable(n):
        return F.count_if(~C.finite(F.col(n).try_cast("double"))).alias(f"bad_{n}")

    groups = features.groupBy(*FEATURE_KEYS).agg(
        F.count(F.lit(1)).alias("_copies"), *[unusable(n) for n in names]
    )
    totals = groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
        *[F.coalesce(F.sum(f"bad_{n}"), F.lit(0)).alias(f"bad_{n}") for n in names],
    )
    bad = reduce(lambda a, b: a + b, [F.col(f"bad_{n}") for n in names])
    return totals.withColumn("passed", (F.col("duplicate_keys") == 0) & (bad == 0))


def require_scorable(features: DataFrame, names=None) -> DataFrame:
    """The frame itself; an error with the counts when a key repeats or a value is unusable."""
    row = feature_integrity(features, names).first()
    if not row["passed"]:
        raise ValueError(f"features cannot be scored: {row.asDict()}")
    return features


def key_match(left: DataFrame, right: DataFrame, keys=FEATURE_KEYS) -> DataFrame:
    """Uniqueness on both sides of a one-to-one join and how many keys meet."""
    def side(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = side(left, "_l").join(side(right, "_r"), list(keys), "full")
    return both.agg(
        F.count_if(F.col("_l") > 1).alias("left_duplicates"),
        F.count_if(F.col("_r") > 1).alias("right_duplicates"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched_keys"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def leakage_checks(labelled: DataFrame, hourly: DataFrame, train_end: Column) -> DataFrame:
    """One row per check that no feature reaches into the hour it is to predict."""
    target = hourly.select(
        "grid_id", F.col("timestamp").alias("prediction_timestamp"),
        F.col("total_activity").alias("_actual"),
    )
    aligned = labelled.withColumn(
        "_train", F.col("prediction_timestamp") <= train_end
    ).join(target, ["grid_id", "prediction_timestamp"], "left")
    step = F.unix_timestamp("prediction_timestamp") - F.unix_timestamp("feature_timestamp")
    same = F.coalesce(F.col("_actual") == F.col("future_total_activity"), F.lit(False))
    above = F.col("future_total_activity") > F.col("high_activity_threshold")
    per_key = aligned.groupBy(*FEATURE_KEYS).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(step <= 0).alias("_before"),
        F.count_if(step != 3600).alias("_step"),
        F.count_if(~same).alias("_target"),
        F.count_if(F.col("HIGH_ACTIVITY") != above.cast("int")).alias("_label"),
        F.max(F.when(F.col("_train"), F.col("prediction_timestamp"))).alias("_train_max"),
        F.min(F.when(~F.col("_train"), F.col("prediction_timestamp"))).alias("_test_min"),
    )
    summed = per_key.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_features"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
            ("_before", "feature_not_before_target"), ("_step", "target_not_next_hour"),
            ("_target", "target_misaligned"), ("_label", "label_disagrees"))],
        F.max("_train_max").alias("_train_max"),
        F.min("_test_min").alias("_test_min"),
    )
    overlap = F.coalesce(F.col("_train_max") >= F.col("_test_min"), F.lit(True)).cast("bigint")
    names = ["duplicate_features", "feature_not_before_target", "target_not_next_hour",
             "target_misaligned", "label_disagrees"]
    listed = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in names],
        F.struct(F.lit("train_test_overlap").alias("check"), overlap.alias("failures")),
        F.struct(F.lit("no_rows").alias("check"),
                 (F.col("rows") == 0).cast("bigint").alias("failures")),
    )
    return summed.select(F.explode(listed).alias("_c")).select(
        "_c.*", (F.col("_c.failures") == 0).alias("passed")
    )


def request_errors(requests: DataFrame) -> DataFrame:
    """Adds `errors`, the names of the bounds each scoring request breaks."""
    at_least_zero = ["avg_activity", "active_hours", "peak_ratio", "variability", "internet_share"]
    upper = {"active_hours": 24, "internet_share": 1}
    found = [F.when(F.col(n).isNull(), f"{n}_missing").when(F.col(n) < 0, f"{n}_negative")
             for n in at_least_zero]
    found += [F.when(F.col(n) > most, f"{n}_above_{most}") for n, most in upper.items()]
    found += [F.when(F.col("activity_growth").isNull(), "activity_growth_missing")]
    return requests.withColumn("errors", F.array_compact(F.array(*found)))
