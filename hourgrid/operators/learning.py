"""Next-hour risk: split, training, threshold choice, evaluation and batch scoring."""

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C
from hourgrid.functions.keys import number_of_ranges, range_cuts, range_of
from hourgrid.operators.boosting import LeafwiseModel
from hourgrid.operators.quality import request_errors, require_scorable
from hourgrid.operators.series import hour_range_features, join_features
from hourgrid.session import cut_lineage

# The threshold grid, 0.10 to 0.90 in steps of 0.01.
FIRST_THRESHOLD, THRESHOLD_STEP, THRESHOLDS = 0.10, 0.01, 81
# Training rows for each task of boosting, and a number of tasks that is never brought down.
ROWS_A_TASK, FEW_TASKS = 10_000, 8


def class_balance(labelled: DataFrame, label="HIGH_ACTIVITY") -> DataFrame:
    counted = labelled.agg(
        F.count_if(F.col(label) == 0).alias("count_0"),
        F.count_if(F.col(label) == 1).alias("count_1"),
        F.count(F.lit(1)).alias("rows"),
    )
    return counted.withColumns({
        f"percent_{v}": C.safe_ratio(F.col(f"count_{v}"), F.col("rows")) * 100 for v in (0, 1)
    })


def split_time(features: DataFrame, share=S.TRAIN_SHARE, time="feature_timestamp") -> DataFrame:
    """One row: the last training time, at `share` of the distinct feature times."""
    # One row per distinct hour, so ordering them in one task is bounded by the calendar.
    times = features.select(time).distinct()
    marked = times.select(
        time, F.row_number().over(W.orderBy(time)).alias("_n"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("_all"),
    )
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("_all") * F.lit(share)), F.col("_all") - 1))
    return marked.filter(F.col("_n") == cut).select(F.col(time).alias("train_end"))


def chronological_split(labelled: DataFrame, train_end: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test): targets up to the cut, and after it."""
    late = F.col("prediction_timestamp") > train_end
    return labelled.filter(~late), labelled.filter(late)


def fit_classifier(
    train: DataFrame, label="HIGH_ACTIVITY", names=S.MODEL_FEATURES, trees=300, rate=0.05,
    depth=5, sampling=0.8, seed=42,
) -> PipelineModel:
    """Boosted trees on the model features; depth 5 allows the same 31 leaves and more."""
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="model_features"),
        GBTClassifier(
            featuresCol="model_features", labelCol=label, maxIter=trees, stepSize=rate,
            maxDepth=depth, subsamplingRate=sampling, featureSubsetStrategy=str(sampling),
            seed=seed,
        ),
    ]
    rows = train.select(*names, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Each of the jobs of boosting would ship the plan of the windows; it cuts its own lineage in the same folder.
        held = cut_lineage(gathered(rows))
    finally:
        rows.unpersist()
    return Pipeline(stages=stages).fit(held)


def gathered(rows: DataFrame) -> DataFrame:
    """All `rows`, which are persisted, in as many tasks as their number asks for.

    Boosting runs a job of two stages for each level of each tree, so its time on spread-out rows is that of starting
    tasks. The draws of a tree go by task and place in it, as Spark's do; up to `FEW_TASKS` tasks stay as they are.
    """
    wanted = max(-(-rows.count() // ROWS_A_TASK), 1)
    now = rows.rdd.getNumPartitions()
    return rows.coalesce(wanted) if wanted < now and now > FEW_TASKS else rows


def model_inputs(model: PipelineModel | LeafwiseModel) -> list[str]:
    if isinstance(model, LeafwiseModel):
        return model.inputs
    return model.stages[0].getInputCols()


def require_model_schema(model: PipelineModel | LeafwiseModel, features: DataFrame) -> None:
    """An error when the model's inputs are not the contract or not in the frame."""
    inputs = model_inputs(model)
    if inputs != S.MODEL_FEATURES:
        raise ValueError(f"the model expects {inputs}, the contract is {S.MODEL_FEATURES}")
    C.require_columns(features, inputs)


def with_probability(
    model: PipelineModel | LeafwiseModel, rows: DataFrame, name="prediction_probability"
) -> DataFrame:
    if isinstance(model, LeafwiseModel):
        return model.with_probability(rows, name)
    scored = model.transform(rows)
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(
        "model_features", "rawPrediction", "probability", "prediction"
    )


def risk_rows(scored: DataFrame, version: str, probability="prediction_probability") -> DataFrame:
    """Rows of the risk table from scored feature rows."""
    return scored.select(
        "grid_id", F.col("feature_timestamp").alias("timestamp"),
        F.col(probability).alias("risk_score"),
        C.risk_level(F.col(probability)).alias("risk_level"),
        F.lit(version).alias("model_version"),
    )


def batch_score(
    model: PipelineModel | LeafwiseModel, windowed: DataFrame, temporal: DataFrame, version: str
) -> DataFrame:
    """Stored window features and fresh temporal features, checked, to risk rows."""
    rows = join_features(windowed, temporal, "inner")
    require_model_schema(model, rows)
    return risk_rows(with_probability(model, require_scorable(rows)), version)


def score_requests(
    model: PipelineModel | LeafwiseModel, requests: DataFrame, hourly: DataFrame, version: str
) -> DataFrame:
    """Valid requests scored with exact-hour features of their own grid and time."""
    valid = request_errors(requests).filter(F.size("errors") == 0).drop("errors")
    # Only grids that are asked for need their series.
    wanted = hourly.join(valid.select("grid_id").distinct(), "grid_id", "left_semi")
    known = join_features(valid, hour_range_features(wanted), "inner")
    return risk_rows(with_probability(model, known), version)


def with_prediction(scored: DataFrame, threshold, probability="prediction_probability"):
    chosen = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scored.withColumn("MODEL_PREDICTION", (F.col(probability) >= chosen).cast("int"))


def feature_importance(model: PipelineModel | LeafwiseModel) -> DataFrame:
    """Importance per model input, highest first; as many rows as the model has inputs."""
    spark = SparkSession.active()
    if isinstance(model, LeafwiseModel):
        return model.importance(spark)
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(model_inputs(model), weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def threshold_sweep(scored: DataFrame, label="HIGH_ACTIVITY", probability="prediction_probability"):
    """Quality of every threshold from one count of rows.

    A row is put in the class of the highest threshold it reaches; at most 82 class
    counts remain, and sums from the top give what each threshold calls positive.
    """
    p = F.col(probability)

    def value(k):
        return F.lit(FIRST_THRESHOLD) + k * F.lit(THRESHOLD_STEP)

    guess = F.floor((p - FIRST_THRESHOLD) / THRESHOLD_STEP)
    reached = guess + (p >= value(guess)).cast("int") + (p >= value(guess + 1)).cast("int")
    classes = scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(THRESHOLDS), reached))
                             .cast("bigint").alias("_j")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    blank = scored.sparkSession.range(THRESHOLDS + 1).select(
        F.col("id").alias("_j"), F.lit(0).cast("bigint").alias("_pos"),
        F.lit(0).cast("bigint").alias("_neg"),
    )
    filled = classes.unionByName(blank).groupBy("_j").agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
    )
    down = W.orderBy(F.desc("_j")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    counts = filled.select(
        "_j",
        F.sum("_pos").over(down).alias("tp"), F.sum("_neg").over(down).alias("fp"),
        F.sum("_pos").over(every).alias("_p"), F.sum("_neg").over(every).alias("_n"),
    ).filter(F.col("_j") > 0)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "_p", "_n"))
    precision, recall = C.safe_ratio(tp, tp + fp), C.safe_ratio(tp, pos)
    return counts.select(
        value(F.col("_j") - 1).alias("threshold"), "tp", "fp",
        C.safe_ratio(tp + neg - fp, pos + neg).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        C.safe_ratio(2 * tp, pos + tp + fp).alias("f1"),
        ((recall + C.safe_ratio(neg - fp, neg)) / 2).alias("balanced_accuracy"),
    )


def best_threshold(
    sweep: DataFrame, min_precision=S.MIN_PRECISION, min_accuracy=S.MIN_ACCURACY
) -> DataFrame:
    """Highest recall among thresholds that are precise and accurate enough, else highest F1."""
    row = F.struct(*sweep.columns)
    fits = (F.col("precision") >= min_precision) & (F.col("accuracy") >= min_accuracy)
    first = -F.col("threshold")  # among equals the lowest threshold
    by_recall = F.struct("recall", "f1", "precision", "accuracy", first)
    by_f1 = F.struct("f1", "recall", "precision", "accuracy", first)
    picked = sweep.agg(
        F.max_by(F.when(fits, row), F.when(fits, by_recall)).alias("_fit"),
        F.max_by(row, by_f1).alias("_any"),
    )
    return picked.select(
        F.coalesce("_fit", "_any").alias("_row"), F.col("_fit").isNotNull().alias("meets_limits")
    ).select("_row.*", "meets_limits")


def auc(scored: DataFrame, label="HIGH_ACTIVITY", probability="prediction_probability",
        buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half.

    Equal scores are merged first. Distinct scores are cut into ranges of like size by a
    sketch, as many as shuffle partitions; each range is summed on its own and only the range totals are
    ordered together.
    """
    scores = scored.groupBy(F.col(probability).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    splits = range_cuts(scores, F.col("_s"), buckets or number_of_ranges(scored))
    placed = scores.withColumn("_cuts", splits).withColumn("_b", range_of(F.col("_cuts"), F.col("_s")))
    inside = W.partitionBy("_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    ranges = placed.select("_b", "_pos", "_neg",
                           (F.col("_pos") * (below + F.col("_neg") / 2)).alias("_w")).groupBy("_b").agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.sum("_w").alias("_w")
    )
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("_neg").over(before), F.lit(0))
    summed = ranges.select("_pos", "_neg", (F.col("_w") + F.col("_pos") * lower).alias("_w")).agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.sum("_w").alias("_w")
    )
    return summed.select(
        "positives", "negatives",
        C.safe_ratio(F.col("_w"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
    )


def evaluator_auc(scored: DataFrame, label="HIGH_ACTIVITY", probability="prediction_probability"):
    """The same figure from Spark ML, as a number."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=probability, labelCol=label, numBins=0
    ).evaluate(scored.withColumn(label, F.col(label).cast("double")))


def prediction_bias(predicted: DataFrame, label="HIGH_ACTIVITY") -> DataFrame:
    """Actual and predicted positive rates and their relative difference in percent."""
    rates = predicted.agg(
        F.avg(F.col(label)).alias("actual_rate"), F.avg("MODEL_PREDICTION").alias("predicted_rate")
    )
    gap = F.col("predicted_rate") - F.col("actual_rate")
    return rates.withColumn("bias_percent", C.safe_ratio(gap, F.col("actual_rate")) * 100)


def risk_summary(risk: DataFrame) -> DataFrame:
    """Rows per level and keys that occur more than once."""
    per_key = risk.groupBy(*S.KEYS).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("risk_level") == v).alias(v) for v in ("HIGH", "ATTENTION", "LOW")],
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v.lower()}_rows")
          for v in ("HIGH", "ATTENTION", "LOW")],
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
    )
