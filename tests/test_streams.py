"""Rule alerts on a stream against the batch rules, and scores added to a store by micro-batches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import aggregate, alerts, learning
from hourgrid.sources.snapshots import Store
from hourgrid.streaming import live

START = dt.datetime(2024, 1, 1)


def arrivals(spark, folder, batches):
    """One file of parsed activity a batch, in order of their times of writing."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(START + dt.timedelta(minutes=m), g, v) for m, g, v in rows], "timestamp timestamp, grid_id string, v double")
        made = made.select("timestamp", "grid_id", F.lit("39").alias("country_code"), F.col("v").alias("sms_in"), F.lit(None).cast("double").alias("sms_out"),
                           F.lit(1.0).alias("call_in"), F.lit(0.0).alias("call_out"), F.col("v").alias("internet_activity"))
        made.coalesce(1).write.parquet(str(folder / f"w{i}"))
        part = next((folder / f"w{i}").glob("part-*.parquet"))
        target = folder / "in" / f"{i:03d}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.read.parquet(str(folder / "in")).schema, str(folder / "in")


def test_rule_alerts_on_a_stream(spark, tmp_path):
    """Out-of-order rows count, rows behind the watermark do not; days without rows and grids with gaps in between."""
    rng = random.Random(61)
    batches, dropped = [], 0
    for b in range(16):  # six hours a batch, four days
        rows = []
        for h in range(6 * b, 6 * b + 6):
            for g in ("1", "2", "3"):
                if (g == "2" and 24 <= h < 72) or (g == "3" and rng.random() < 0.3):
                    continue
                rows += [(60 * h + rng.randrange(60), g, float(rng.choice([1, 5, 10, 30]))) for _ in range(rng.choice([1, 3]))]
        rng.shuffle(rows)
        batches.append(rows)
    for b in range(2, 14, 3):  # one hour late is in time, the rows of a day before are not
        early, late = batches[b][:2], [(60 * (6 * b - 30) + 5, "1", 500.0)]
        batches[b] = batches[b][2:] + late
        batches[b + 1] += [(60 * (6 * (b + 1)) - 20, g, v) for _, g, v in early]
        dropped += 1
    in_time = [r for rows in batches for r in rows if r[2] != 500.0]
    batches.append([(60 * 24 * 9, "4", 1.0)])  # moves the watermark past the last day
    batches.append([(60 * 24 * 9 + 60, "4", 1.0)])
    schema, folder = arrivals(spark, tmp_path / "stream", batches)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    floor = 60.0
    store, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "ck")
    days = live.finished_days(stream, late="6 hours")
    live.rule_alert_stream(days, floor, store, "alerts", checkpoint).trigger(availableNow=True).start().awaitTermination()
    _, kept = arrivals(spark, tmp_path / "kept", [in_time])
    hourly = aggregate.hourly_grid(spark.read.parquet(kept))
    want = alerts.rule_alerts(hourly, floor)
    got = store.read("alerts").select(*want.columns)
    assert dropped and want.count() > 80 and {r[0] for r in want.select("alert_type").distinct().collect()} == set(S.ALERT_TYPES)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.fixture(scope="module")
def features(spark):
    rows = spark.range(600).select(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("grid_id"),
                                   (F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("id") / 5).cast("int"))).alias("feature_timestamp"),
                                   *[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(S.MODEL_FEATURES)])
    return rows.withColumn("HIGH_ACTIVITY", (F.col(S.MODEL_FEATURES[0]) > 8).cast("int"))


def test_added_score_stream(spark, tmp_path, features):
    """Each micro-batch writes its own rows; reads equal the upsert; a batch that runs again adds nothing; folding keeps the rows."""
    model = learning.fit_classifier(features, trees=2)
    source = tmp_path / "features"
    source.mkdir()
    sent = [features.filter("feature_timestamp < '2024-01-03'"), features.filter("grid_id = 'g1'").withColumn(S.MODEL_FEATURES[0], F.lit(0.0)),
            features.filter("feature_timestamp >= '2024-01-03'")]
    store, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "ck")
    want = None
    for i, rows in enumerate(sent):
        rows.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(features.schema).parquet(str(source))
        live.added_score_stream(stream, model, store, "risk", "v1", checkpoint, fold_every=3 if i == 2 else 0).trigger(
            availableNow=True).start().awaitTermination()
        scores = learning.risk_rows(learning.with_probability(model, rows), "v1")
        want = scores if want is None else want.join(scores, S.KEYS, "left_anti").unionByName(scores)
        parts = store.parts("risk")
        got = store.newest("risk", S.KEYS).select(*want.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
        if i == 1:  # only the five dates of one grid were written again
            last = [f for p, f in parts.items() if store.load("risk", store.schema("risk"), [f]).filter("_version = 2").count()]
            assert store.load("risk", store.schema("risk"), last).count() == rows.count() == 120
    assert all("@" not in p for p in store.parts("risk")) and store.last() >= 5
    before = store.last()
    live.added_score_stream(spark.readStream.schema(features.schema).parquet(str(source)), model, store, "risk", "v1", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    assert store.last() == before and store.holds_token(f"{checkpoint}#2")
