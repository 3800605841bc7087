"""Split, training, thresholds, scoring, text checks and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from hourgrid import schema as S
from hourgrid.operators import aggregate, clean, grounding, learning, series
from hourgrid.plans.fixtures import Workspace
from hourgrid.sources import sinks
from hourgrid.streaming import live


@pytest.fixture(scope="module")
def ws(spark, folder):
    return Workspace(spark, folder)


@pytest.fixture(scope="module")
def model(ws):
    train, _ = learning.chronological_split(ws.labelled, ws.train_end)
    return learning.fit_classifier(train, trees=3, depth=2)


def scored(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(rng.normal(0.35 + 0.3 * y, 0.2), 0, 1), 2)
    return pd.DataFrame({"HIGH_ACTIVITY": y, "prediction_probability": p})


def test_sweep_matches_direct_counts(spark):
    df = scored(spark)
    got = learning.threshold_sweep(spark.createDataFrame(df)).orderBy("threshold").toPandas()
    assert len(got) == 81
    for k, r in enumerate(got.itertuples()):
        t = np.float64(0.10) + k * np.float64(0.01)
        called = df.prediction_probability >= t
        tp, fp = int((called & (df.HIGH_ACTIVITY == 1)).sum()), int((called & (df.HIGH_ACTIVITY == 0)).sum())
        assert (r.threshold, r.tp, r.fp) == (t, tp, fp)
        assert r.accuracy == pytest.approx(((called == (df.HIGH_ACTIVITY == 1)).mean()))


def test_best_threshold_prefers_recall_within_limits(spark):
    cols = "threshold double, precision double, recall double, f1 double, accuracy double"
    rows = [(0.1, 0.5, 0.9, 0.64, 0.95), (0.2, 0.6, 0.7, 0.65, 0.9), (0.3, 0.7, 0.7, 0.7, 0.92), (0.4, 0.9, 0.1, 0.2, 0.9)]
    assert learning.best_threshold(spark.createDataFrame(rows, cols)).first()["threshold"] == 0.3
    low = [(t, p, r, f, 0.5) for t, p, r, f, _ in rows] + [(0.05, 0.7, 0.7, 0.7, 0.5)]
    row = learning.best_threshold(spark.createDataFrame(low, cols)).first()
    assert (row["threshold"], row["meets_limits"]) == (0.05, False)


def test_auc_forms_agree(spark):
    frame = spark.createDataFrame(scored(spark))
    mine = learning.auc(frame).first()["auc"]
    assert mine == pytest.approx(learning.evaluator_auc(frame), abs=1e-9)
    assert learning.auc(frame, buckets=7).first()["auc"] == pytest.approx(mine, abs=1e-12)


def test_split_is_chronological(ws):
    train, test = learning.chronological_split(ws.labelled, ws.train_end)
    last = train.agg(F.max("prediction_timestamp")).first()[0]
    first = test.agg(F.min("prediction_timestamp")).first()[0]
    assert last < first
    times = sorted(r[0] for r in ws.features.select("feature_timestamp").distinct().collect())
    assert ws.spark.range(1).select(ws.train_end).first()[0] == times[int(len(times) * 0.8) - 1]


def test_batch_scores(ws, model):
    rows = learning.batch_score(model, series.feature_windows(ws.hourly),
                                series.temporal_features(ws.hourly), "gbt-test").cache()
    assert rows.count() == series.feature_windows(ws.hourly).count()
    assert rows.filter("risk_score < 0 OR risk_score > 1 OR risk_level IS NULL").count() == 0
    assert rows.schema.simpleString() == S.RISK_SCHEMA.simpleString()
    assert learning.risk_summary(rows).first()["duplicate_keys"] == 0
    weights = learning.feature_importance(model).collect()
    assert len(weights) == 11 and sum(r["importance"] for r in weights) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        learning.require_model_schema(model, ws.features.drop("variability"))


def test_request_scores_skip_invalid_requests(ws, model):
    asked = series.feature_windows(ws.hourly).limit(6).cache()
    wrong = asked.withColumn("internet_share", F.lit(2.0))
    got = learning.score_requests(model, asked.unionByName(wrong), ws.hourly, "v")
    assert got.count() == 6


def test_boosting_runs_few_tasks(spark, monkeypatch):
    """Spread-out training rows are all learned from, in tasks by their number and not by the layout."""
    rows = spark.range(300).select(*[((F.col("id") * (k + 3)) % 17).cast("double").alias(n) for k, n in enumerate(S.MODEL_FEATURES)],
                                   (F.col("id") % 17 > 8).cast("int").alias("HIGH_ACTIVITY"))
    seen = []
    fit = learning.Pipeline.fit
    monkeypatch.setattr(learning.Pipeline, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    model = learning.fit_classifier(rows.repartition(40), trees=2, depth=2)
    assert learning.with_probability(model, rows).count() == 300
    monkeypatch.setattr(learning, "ROWS_A_TASK", 100)
    learning.fit_classifier(rows.repartition(40), trees=1, depth=2)
    learning.fit_classifier(rows.repartition(5), trees=1, depth=2)
    assert seen == [(1, 300), (3, 300), (5, 300)]


def test_boosting_is_rid_of_the_windows(spark, monkeypatch):
    """The jobs of boosting start from stored rows, not from the plan behind them, and grow the trees of a plain fit."""
    spec = W.partitionBy(F.col("id") % 7).orderBy("id").rowsBetween(-3, 0)
    train = spark.range(400).select(
        *[F.avg((F.col("id") * (k + 3)) % 17).over(spec).alias(n) for k, n in enumerate(S.MODEL_FEATURES)],
        (F.col("id") % 17 > 8).cast("int").alias("HIGH_ACTIVITY"))
    seen = []
    fit = learning.Pipeline.fit

    def watched(pipeline, df):
        seen.append((df._jdf.queryExecution().optimizedPlan().toString(), pipeline.getStages()))
        return fit(pipeline, df)

    monkeypatch.setattr(learning.Pipeline, "fit", watched)
    model = learning.fit_classifier(train, trees=12, depth=3)
    plan, stages = seen[0]
    assert "LogicalRDD" in plan and "Window" not in plan and "InMemoryRelation" not in plan
    plain = fit(learning.Pipeline(stages=stages), train.select(*S.MODEL_FEATURES, "HIGH_ACTIVITY").cache())
    assert all(t.numNodes > 1 for t in model.stages[-1].trees)
    assert [t.toDebugString.split("\n")[1:] for t in model.stages[-1].trees] == [
        t.toDebugString.split("\n")[1:] for t in plain.stages[-1].trees]


def test_model_survives_saving(ws, model, tmp_path):
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (learning.with_probability(m, ws.features).agg(F.sum("prediction_probability")).first()[0]
            for m in (model, again))
    assert a == pytest.approx(b)


TEXT = "SEVERITY high\nEVIDENCE\n1. load {}\nINTERPRETATION 777\nNEXT CHECKS none"


@pytest.mark.parametrize("part,wrong", [
    ("100.5", []), ("102.4", []), ("103", ["103"]), ("0.25", []), ("25%", []), ("25.4%", []), ("26%", ["26%"]),
    ("17", []), ("17.0", ["17.0"]), ("21", ["21"]), ("x9", []), ("-3 -3", ["-3"]), ("-0.25", ["-0.25"]),
    ("5-100.5", []), ("é90", ["90"])])
def test_number_support(spark, part, wrong):
    df = spark.createDataFrame([(TEXT.format(part), [100.5, 0.25, None])], "t string, e array<double>")
    assert df.select(grounding.unsupported_numbers(F.col("t"), F.col("e"))).first()[0] == wrong


def test_text_checks(spark):
    rows = [(TEXT.format("1"), None), ("EVIDENC", 1.0), ("Insufficient Evidence; there IS congestion", None),
            ("It is experiencing congestion", 0.5)]
    df = spark.createDataFrame(rows, "response string, anomaly_score double").withColumn(
        "evidence", F.array(F.col("anomaly_score")))
    got = grounding.grounding_report(df).collect()
    assert [r["sections_ok"] for r in got] == [True, False, False, False]
    assert [r["no_congestion_claim"] for r in got] == [True, True, False, False]
    assert [r["insufficiency_ok"] for r in got] == [False, True, True, True]
    assert got[1]["unsupported"] == [grounding.NO_SECTION]


@pytest.fixture
def stream(spark, ws, tmp_path):
    path = str(tmp_path / "raw")
    ws.parsed.select("timestamp", "grid_id", "country_code", *S.MEASURES).write.parquet(path)
    return spark.readStream.schema(S.ACTIVITY_SCHEMA).parquet(path)


def drain(df, tmp_path, name):
    out = str(tmp_path / name)
    df.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / f"{name}-state")
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_hourly_stream_equals_batch(spark, ws, stream, tmp_path):
    got = drain(live.hourly_stream(stream, scale=4), tmp_path, "hours")
    batch = ws.hourly.select("grid_id", "timestamp", *S.MEASURES, *S.TOTALS)
    assert got.count() > 0.95 * batch.count()  # the last open hours stay in the state
    assert got.exceptAll(batch).count() == 0
    closed = got.agg(F.max("timestamp")).first()[0]
    assert batch.filter(F.col("timestamp") <= F.lit(closed)).count() == got.count()


def test_alert_stream(spark, ws, stream, tmp_path):
    base = live.hour_baselines(ws.hourly)
    got = drain(live.alert_stream(live.hourly_stream(stream, scale=4), base), tmp_path, "alerts")
    want = live.alert_stream(ws.hourly, base)
    assert 0 < got.count() <= want.count()
    assert got.select(*S.KEYS, "anomaly_direction").exceptAll(
        want.select(*S.KEYS, "anomaly_direction")).count() == 0


def test_score_stream_can_repeat_a_batch(spark, ws, model, tmp_path):
    path, risk = str(tmp_path / "features"), str(tmp_path / "risk")
    ws.features.write.parquet(path)
    empty = spark.createDataFrame([], S.RISK_SCHEMA).withColumn("date", F.to_date("timestamp"))
    first = learning.risk_rows(learning.with_probability(model, ws.features.limit(1)), "old")
    sinks.write_by_date(first.withColumn("date", F.to_date("timestamp")).unionByName(empty), risk)
    for attempt in ("a", "b"):
        source = spark.readStream.schema(ws.features.schema).parquet(path)
        live.score_stream(source, model, risk, "v1", str(tmp_path / attempt)).trigger(
            availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(risk)
    assert stored.count() == ws.features.count()
    assert {r[0] for r in stored.select("model_version").distinct().collect()} == {"v1"}


def test_null_mode_keeps_empty_groups_null(spark):
    rows = [("1", "2024-01-01 00:10:00", None), ("1", "2024-01-01 01:10:00", 2.0)]
    raw = spark.createDataFrame(rows, "grid_id string, timestamp string, sms_in double").withColumns(
        {"country_code": F.lit("39"), **{m: F.lit(None).cast("double") for m in S.MEASURES[1:]}})
    parsed = clean.parse_activity(raw)
    kept = aggregate.hourly_grid(parsed, null_mode="propagate").orderBy("timestamp").collect()
    assert kept[0]["sms_in"] is None and kept[0]["total_activity"] is None and kept[1]["sms_in"] == 2.0
    filled = aggregate.hourly_grid(parsed).orderBy("timestamp").collect()
    assert [r["total_activity"] for r in filled] == [0.0, 2.0]
