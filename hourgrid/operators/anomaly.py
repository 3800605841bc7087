"""Hour-of-day anomaly scores and their comparison with alerts and predictions."""

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C
from hourgrid.functions.quantiles import leave_one_out_median
from hourgrid.operators.alerts import alert_keys

X = "total_activity"


def anomaly_direction(score: Column) -> Column:
    return (
        F.when(score >= S.ANOMALY_THRESHOLD, "HIGH")
        .when(score <= -S.ANOMALY_THRESHOLD, "LOW")
        .otherwise("NORMAL")
    )


# The texts stored with scores.
REASON_UNKNOWN = "No historical baseline available."
REASON_HIGH = "Activity %.2f is %.1f%% above the hour-of-day baseline (%.2f)."
REASON_LOW = "Activity %.2f is %.1f%% below the hour-of-day baseline (%.2f)."
REASON_NORMAL = "Activity %.2f is within the ±50%% normal range around the baseline (%.2f)."


def anomaly_reason() -> Column:
    score, base = F.col("anomaly_score"), F.col("baseline_activity")
    return (
        F.when(base.isNull(), REASON_UNKNOWN)
        .when(F.col("anomaly_direction") == "HIGH", F.format_string(REASON_HIGH, F.col(X), score * 100, base))
        .when(F.col("anomaly_direction") == "LOW", F.format_string(REASON_LOW, F.col(X), F.abs(score) * 100, base))
        .otherwise(F.format_string(REASON_NORMAL, F.col(X), base))
    )


def anomaly_scores(hourly: DataFrame) -> DataFrame:
    """Relative distance from the median of the grid's other days at that hour.

    Laid out by grid before the bucket windows, so other windows of the same grid
    can follow or precede without another exchange.
    """
    hours = hourly.select(*S.KEYS, X, F.hour("timestamp").alias("hour_of_day"))
    based = leave_one_out_median(hours, ["grid_id", "hour_of_day"], X, "baseline_activity")
    base = F.col("baseline_activity")
    return (
        based.withColumn("anomaly_score", F.when(base > 0, (F.col(X) - base) / base))
        .withColumn("anomaly_direction", anomaly_direction(F.col("anomaly_score")))
        .withColumn("anomaly_flag", (F.col("anomaly_direction") != "NORMAL").cast("int"))
        .withColumn("reason", anomaly_reason())
    )


def history_depth(hourly: DataFrame) -> DataFrame:
    """Days of history per grid and hour of day."""
    return hourly.groupBy("grid_id", F.hour("timestamp").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("history_count")
    )


def history_summary(hourly: DataFrame) -> DataFrame:
    return history_depth(hourly).agg(
        F.count(F.lit(1)).alias("buckets"),
        F.min("history_count").alias("min_history"),
        F.max("history_count").alias("max_history"),
        F.avg("history_count").alias("avg_history"),
    )


def category_counts(df: DataFrame, name: str, categories, count_name="rows") -> DataFrame:
    """Counts for every listed category, zero where it does not occur."""
    counted = df.filter(F.col(name).isin(list(categories))).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    by_name = counted.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(name), F.col("_n")))).alias("_by")
    )
    listed = F.explode(F.array(*[F.lit(c) for c in categories])).alias(name)
    return by_name.select("_by", listed).select(
        name, F.coalesce(F.try_element_at("_by", F.col(name)), F.lit(0)).alias(count_name)
    )


def anomaly_sanity(scores: DataFrame) -> DataFrame:
    """Every bucket deeper than one row, and both directions present."""
    depth = scores.groupBy("grid_id", "hour_of_day").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("anomaly_direction") == "HIGH").alias("_high"),
        F.count_if(F.col("anomaly_direction") == "LOW").alias("_low"),
    )
    return depth.agg(
        F.min("_n").alias("min_history"),
        F.count_if(F.col("_n") <= 1).alias("singleton_buckets"),
        F.coalesce(F.sum("_high"), F.lit(0)).alias("high_rows"),
        F.coalesce(F.sum("_low"), F.lit(0)).alias("low_rows"),
    ).withColumns({
        "depth_ok": F.coalesce(F.col("min_history") > 1, F.lit(False)),
        "directions_ok": (F.col("high_rows") > 0) & (F.col("low_rows") > 0),
    })


def with_alert_flag(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """1 where the predicted hour has an alert, else 0."""
    keys = alert_keys(alerts).select(
        "grid_id", F.col("timestamp").alias("prediction_timestamp"), F.lit(1).alias("NP3_ALERT")
    )
    return predictions.join(keys, ["grid_id", "prediction_timestamp"], "left").fillna(
        0, subset=["NP3_ALERT"]
    )


def two_way_agreement(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Model against rules, for every prediction."""
    model, rule = F.col("MODEL_PREDICTION") == 1, F.col("NP3_ALERT") == 1
    category = C.first_match(
        list(zip([model & rule, model, rule], S.AGREEMENT)), S.AGREEMENT[-1]
    )
    return with_alert_flag(predictions, alerts).withColumn("agreement_category", category)


def three_way_comparison(
    predictions: DataFrame, scores: DataFrame, alerts: DataFrame
) -> DataFrame:
    """Model, anomaly score and rules at the predicted hour, for every prediction."""
    scored = scores.select(
        "grid_id", F.col("timestamp").alias("prediction_timestamp"),
        "anomaly_score", "anomaly_direction", "anomaly_flag", X, "baseline_activity",
    )
    joined = with_alert_flag(
        predictions.select("grid_id", "prediction_timestamp", "MODEL_PREDICTION",
                           "prediction_probability")
        .join(scored, ["grid_id", "prediction_timestamp"], "left"),
        alerts,
    ).withColumns({
        "ML4_ANOMALY": F.coalesce(F.col("anomaly_flag"), F.lit(0)),
        "ML3_PREDICTION": F.col("MODEL_PREDICTION").cast("int"),
    })
    odd, rule, model = (F.col(c) == 1 for c in ("ML4_ANOMALY", "NP3_ALERT", "ML3_PREDICTION"))
    cases = [odd & rule & model, odd & rule, odd & model, rule & model, odd, rule, model]
    category = C.first_match(list(zip(cases, S.COMPARISON)), S.COMPARISON[-1])
    return joined.withColumn("comparison_category", category)


def representative_disagreement(comparison: DataFrame) -> DataFrame:
    """First row of the first category, in the order of interest, that occurs at all."""
    rank = C.rank_in(F.col("comparison_category"), S.DISAGREEMENT_ORDER)
    order = F.struct(rank, F.col("grid_id"), F.col("prediction_timestamp"))
    picked = comparison.filter(F.col("comparison_category").isin(S.DISAGREEMENT_ORDER)).agg(
        F.min_by(F.struct(*comparison.columns), order).alias("_row")
    )
    return picked.filter(F.col("_row").isNotNull()).select("_row.*")
