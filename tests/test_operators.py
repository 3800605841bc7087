"""Rules, features and reports on small hand-made series and against pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import (
    aggregate, alerts, anomaly, clean, profile, quality, series, serving, warehouse,
)

START = "2013-11-01 00:00:00"


def fact_of(hourly):
    return hourly.select(
        "grid_id", F.col("timestamp").alias("event_time"), F.lit(0.0).alias("sms_count"),
        (F.col("total_activity") - F.col("internet_activity")).alias("call_count"),
        F.col("internet_activity").alias("internet_volume"))


def test_later_rows_do_not_change_earlier_features(hourly):
    base = hourly(("4857", START, range(1, 51)))
    first = series.feature_windows(base).orderBy("feature_timestamp").toPandas()
    assert list(first.feature_timestamp.astype(str)) == [
        "2013-11-02 23:00:00", "2013-11-03 00:00:00", "2013-11-03 01:00:00"]
    late = hourly(("4857", "2013-11-03 00:00:00", [999999999999.0]))
    changed = base.filter("timestamp <> '2013-11-03 00:00:00'").unionByName(late)
    again = series.feature_windows(changed).orderBy("feature_timestamp").toPandas()
    pd.testing.assert_frame_equal(first.head(1), again.head(1))
    assert again.avg_activity[1] > first.avg_activity[1] * 1000
    row = first.iloc[0]
    assert row.avg_activity == np.mean(range(25, 49)) and row.active_hours == 24
    assert row.activity_growth == pytest.approx((36.5 - 12.5) / 12.5)
    assert row.peak_ratio == pytest.approx(48 / 36.5) and row.internet_share == 0.5
    assert row.variability == pytest.approx(np.std(range(25, 49)))


def test_rolling_columns_match_pandas(hourly):
    rng = random.Random(5)
    values = {g: [round(rng.random() * 9, 2) for _ in range(60)] for g in "ab"}
    df = hourly(*[(g, START, v) for g, v in values.items()])
    got = series.rolling_baseline(series.rolling_means(df)).orderBy("timestamp").toPandas()
    for g, v in values.items():
        mine, x = got[got.grid_id == g], pd.Series(v)
        for n in (3, 6, 24):
            np.testing.assert_allclose(mine[f"rolling_{n}h_activity"], x.rolling(n).mean(), rtol=1e-9)
        np.testing.assert_allclose(mine.baseline_activity, x.rolling(24).median(), rtol=1e-12)


def test_labels_need_the_exact_next_hour(hourly):
    df = hourly(("1", START, [1.0] * 50 + [9.0])).filter("timestamp <> '2013-11-03 01:00:00'")
    one_pass = series.feature_table_with_label(df)
    joined = series.next_hour_label(series.feature_table(df), df)
    shown = ["feature_timestamp", "future_total_activity", "HIGH_ACTIVITY", "prediction_timestamp"]
    a, b = (d.select(*shown).orderBy("feature_timestamp").toPandas() for d in (one_pass, joined))
    pd.testing.assert_frame_equal(a, b)
    # 24 h of ones; 01:00 is missing, so only 23:00 has its next hour.
    assert list(a.feature_timestamp.astype(str)) == ["2013-11-02 23:00:00"]
    assert list(a.HIGH_ACTIVITY) == [0]


def brute_alerts(rows, share=0.1):
    """Rule alerts of (grid, hour index, value) rows with plain pandas."""
    df = pd.DataFrame(rows, columns=["g", "i", "x"]).sort_values(["g", "i"])
    df["day"] = df.i // 24
    total = df.groupby(["g", "day"]).x.transform("sum").round(6)
    floor = df.groupby(["g", "day"]).x.sum().round(6).quantile(share)
    df["prev"] = df.groupby("g").x.shift(1)
    out = set()
    for k, r in df.iterrows():
        others = df[(df.g == r.g) & (df.day == r.day) & (df.i != r.i)].x
        if total[k] < floor or others.empty:
            continue
        base = others.median()
        fired = {"HIGH_ACTIVITY": r.x >= base * 1.5, "ACTIVITY_DROP": r.x <= base * 0.7,
                 "ACTIVITY_SPIKE": r.prev > 0 and r.x >= r.prev * 1.5}
        out |= {(r.g, r.i, t) for t, yes in fired.items() if yes}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_match_brute_force(hourly, seed):
    rng = random.Random(seed)
    values = {str(g): [rng.choice([0, 0, 1, 1.5, 2, 3, 4.5]) * g for _ in range(55)] for g in range(1, 7)}
    got = alerts.rule_alerts(hourly(*[(g, START, v) for g, v in values.items()])).withColumn(
        "i", ((F.unix_timestamp("timestamp") - F.unix_timestamp(F.lit(START))) / 3600).cast("int"))
    mine = {(r["grid_id"], r["i"], r["alert_type"]) for r in got.collect()}
    assert mine == brute_alerts([(g, i, x) for g, v in values.items() for i, x in enumerate(v)])


def test_zero_baseline_fires_both_ways_and_reasons(hourly):
    rows = alerts.rule_alerts(hourly(("1", START, [0, 0, 0, 5])), floor=0.0)
    got = {(r["timestamp"].hour, r["alert_type"]): r["reason"] for r in rows.collect()}
    assert set(got) == {(h, t) for h in (0, 1, 2) for t in ("HIGH_ACTIVITY", "ACTIVITY_DROP")} | {
        (3, "HIGH_ACTIVITY")}
    assert got[3, "HIGH_ACTIVITY"] == (
        "Current activity 5.00 is at least 1.50x the within-day baseline 0.00.")
    spike = alerts.rule_alerts(hourly(("1", START, [2, 3])), floor=0.0).collect()
    assert {r["alert_type"]: r["reason"] for r in spike}["ACTIVITY_SPIKE"] == (
        "Activity increased from 2.00 to 3.00, at least 1.50x the previous hour.")
    summary = alerts.alert_summary(rows, hourly(("1", START, [0, 0, 0, 5]))).first()
    assert (summary["alerts"], summary["alerting_grid_hours"], summary["alerting_rate"]) == (7, 4, 1.0)


def test_same_time_alerts_keep_rule_order(hourly):
    rows = alerts.rule_alerts(hourly(("1", START, [0, 0])), floor=0.0)
    last = alerts.latest_per_grid(rows).first()
    assert (last["timestamp"].hour, last["alert_type"]) == (1, "HIGH_ACTIVITY")
    assert alerts.latest_per_grid(rows, F.lit("2013-10-31").cast("timestamp")).count() == 0


def test_anomaly_edges(hourly):
    days = [("1", f"2013-11-0{d} 07:00:00", [x]) for d, x in ((1, 100), (2, 150), (3, 100), (4, 50))]
    days.append(("2", START, [3.0]))
    got = {(r["grid_id"], r["timestamp"].day): r for r in anomaly.anomaly_scores(hourly(*days)).collect()}
    assert got["1", 2]["anomaly_score"] == 0.5 and got["1", 2]["anomaly_direction"] == "HIGH"
    assert got["1", 4]["anomaly_score"] == -0.5 and got["1", 4]["anomaly_direction"] == "LOW"
    assert got["1", 4]["reason"] == "Activity 50.00 is 50.0% below the hour-of-day baseline (100.00)."
    assert got["1", 1]["anomaly_flag"] == 0
    assert got["2", 1]["anomaly_score"] is None and got["2", 1]["anomaly_direction"] == "NORMAL"
    assert got["2", 1]["reason"] == "No historical baseline available."
    checks = anomaly.anomaly_sanity(anomaly.anomaly_scores(hourly(*days))).first()
    assert (checks["singleton_buckets"], checks["depth_ok"], checks["directions_ok"]) == (1, False, True)


def test_comparison_categories(spark):
    time = F.to_timestamp(F.lit(START))
    flags = [(str(i), i & 4, i & 2, i & 1) for i in range(8)]
    df = spark.createDataFrame(flags, "grid_id string, a int, n int, m int")
    predictions = df.select("grid_id", time.alias("prediction_timestamp"),
                            F.col("m").alias("MODEL_PREDICTION"), F.lit(0.5).alias("prediction_probability"))
    scores = df.filter("a > 0").select(
        "grid_id", time.alias("timestamp"), F.lit(1.0).alias("anomaly_score"),
        F.lit("HIGH").alias("anomaly_direction"), F.lit(1).alias("anomaly_flag"),
        F.lit(1.0).alias("total_activity"), F.lit(1.0).alias("baseline_activity"))
    fired = df.filter("n > 0").select("grid_id", time.alias("timestamp"))
    fired = fired.unionByName(fired)  # several alerts in an hour count once
    compared = anomaly.three_way_comparison(predictions, scores, fired)
    got = {r["grid_id"]: r["comparison_category"] for r in compared.collect()}
    assert got == dict(zip("01234567", ["NONE", "ML3_ONLY", "NP3_ONLY", "NP3_ML3", "ML4_ONLY",
                                        "ML4_ML3", "ML4_NP3", "ALL_THREE"]))
    assert anomaly.representative_disagreement(compared).first()["grid_id"] == "4"
    agreed = anomaly.two_way_agreement(predictions, fired)
    counts = anomaly.category_counts(agreed, "agreement_category", S.AGREEMENT)
    assert {r[0]: r[1] for r in counts.collect()} == {c: 2 for c in S.AGREEMENT}
    empty = anomaly.category_counts(agreed.limit(0), "agreement_category", S.AGREEMENT)
    assert {r[0]: r[1] for r in empty.collect()} == {c: 0 for c in S.AGREEMENT}


def movers(spark, rows):
    return spark.createDataFrame(rows, "grid_id string, avg_activity double, activity_growth double").select(
        "*", F.to_timestamp(F.lit(START)).alias("feature_timestamp"))


RISK = "grid_id string, timestamp timestamp, risk_score double, risk_level string, model_version string"


def test_top_movers_apply_the_floor_before_the_limit(spark):
    rows = [(str(i), float(i), 1.0) for i in range(10, 20)] + [("1", 1.0, 99.0)]
    none = spark.createDataFrame([], RISK)
    odd = spark.createDataFrame([], "grid_id string, timestamp timestamp, anomaly_score double, anomaly_direction string")
    at = F.to_timestamp(F.lit(START))
    got = serving.top_movers(movers(spark, rows), none, odd, at, limit=3).toPandas()
    assert sorted(got.grid_id) == ["10", "11", "12"]  # the biggest mover lies under the floor
    assert (got.activity_floor == np.quantile([r[1] for r in rows], 0.1)).all()
    assert serving.top_movers(movers(spark, rows), none, odd, F.lit("2020-01-01").cast("timestamp")).count() == 0


def test_hotspot_severity_applies_after_the_limit(spark, hourly):
    fact = fact_of(hourly(*[(str(g), START, [float(g)]) for g in range(0, 5)]))
    none = spark.createDataFrame([], RISK)
    assert [r["grid_id"] for r in serving.hotspots(fact, none, limit=2).orderBy(F.desc("total_activity")).collect()] == ["4", "3"]
    assert serving.hotspots(fact, none, limit=2, severity="low").count() == 0
    assert serving.hotspots(fact, none, limit=9, severity="low").first()["grid_id"] == "0"
    for wrong in ({"severity": "severe"}, {"limit": 0}):
        with pytest.raises(ValueError):
            serving.hotspots(fact, none, **wrong)


def test_alert_listing_orders(spark):
    rows = [("1", "ACTIVITY_DROP"), ("2", "HIGH_ACTIVITY"), ("3", "ACTIVITY_SPIKE"), ("4", "HIGH_ACTIVITY")]
    df = spark.createDataFrame(rows, "grid_id string, alert_type string").select(
        "*", F.to_timestamp(F.lit(START)).alias("timestamp"), F.lit(1.0).alias("current_activity"),
        F.lit(1.0).alias("baseline_activity"), F.lit("").alias("reason"))
    none, at = spark.createDataFrame([], RISK), F.to_timestamp(F.lit(START))

    def listed(**how):
        return {r["grid_id"] for r in serving.alert_listing(df, none, at, limit=2, **how).collect()}

    assert listed() == {"4", "2"}
    assert serving.alert_listing(df, none, at).count() == 4
    many = spark.range(12_000).select(F.col("id").cast("string").alias("grid_id"), F.lit("ACTIVITY_DROP").alias("alert_type"),
        F.to_timestamp(F.lit(START)).alias("timestamp"), F.lit(1.0).alias("current_activity"), F.lit(1.0).alias("baseline_activity"),
        F.lit("").alias("reason"))
    assert serving.alert_listing(many, none, at).count() == 12_000
    assert serving.alert_listing(many, none, at, limit=11_000).count() == 11_000
    assert listed(order="text") == {"3", "1"}  # MEDIUM, LOW, HIGH by name
    assert listed(severity="low") == {"1"}


def test_drilldown_and_timeline(spark, hourly):
    fact = fact_of(hourly(("1", START, range(200)), ("2", START, range(5))))
    assert serving.grid_drilldown(fact, 1).count() == 24
    assert serving.grid_drilldown(fact, 1, date="2013-11-01", hour=3).count() == 4
    for bad in ({"date": "2013-11-01"}, {"hour": 3}):
        with pytest.raises(ValueError):
            serving.grid_drilldown(fact, 1, **bad)
    with pytest.raises(LookupError):
        serving.grid_drilldown(fact, 10_001, n_cells=10_000)
    none = spark.createDataFrame([], RISK)
    points = [r["timestamp"] for r in serving.grid_timeline(fact, none, 1).collect()]
    assert len(points) == 168 and points == sorted(points)
    assert serving.resolve_as_of(fact).hour == 7
    with pytest.raises(LookupError):
        serving.resolve_as_of(fact, "2000-01-01")


def test_explain_and_review(spark, hourly):
    base = hourly(("1", START, [10.0] * 30 + [13.0]), ("2", START, [4.0]))
    fact = fact_of(base)
    risk = spark.createDataFrame([("1", 0.75)], "grid_id string, risk_score double").select(
        "*", F.to_timestamp(F.lit("2013-11-02 06:00:00")).alias("timestamp"))
    odd = spark.createDataFrame([("1", 2.5)], "grid_id string, anomaly_score double").select(
        "*", F.to_timestamp(F.lit("2013-11-02 06:00:00")).alias("timestamp"))
    places = spark.createDataFrame([], "grid_id string, centroid_latitude double, centroid_longitude double")
    got = {r["grid_id"]: r for r in serving.explain_grids(fact, risk, odd, places).collect()}
    one, two = got["1"], got["2"]
    assert (one["severity"], one["activity_ratio"], one["severity_reason"]) == (
        "high", 1.3, "Activity 1.30x baseline, risk=0.75")
    assert one["next_checks"][3] == "Inspect raw data for anomalous patterns"
    assert (two["severity"], two["baseline_activity"], two["activity_ratio"]) == ("low", 0.0, 1.0)
    assert two["severity_reason"].endswith("risk=N/A")
    rev = serving.review_anomalies(fact, risk, odd, 1, "2013-11-02 06:00:00").first()
    assert (rev["rule_triggered"], rev["agreement"]) == (False, False)
    assert rev["disagreement_analysis"] == (
        "Rule alert (false) differs from classifier (true). "
        "Rule alert (false) differs from anomaly (true). ")
    alone = serving.review_anomalies(fact, risk, odd, 2).first()
    assert alone["agreement"] is None and alone["disagreement_analysis"] == "All signals agree"


def test_request_bounds(spark):
    rows = [(1000.0, 0.1, 24.0, 1.2, 0.15, 0.4), (-1.0, 0.1, 25.0, -1.0, -0.1, 1.5), (1.0, None, -1.0, 0.0, 0.0, -0.2)]
    df = spark.createDataFrame(rows, "avg_activity double, activity_growth double, active_hours double, "
                                     "peak_ratio double, variability double, internet_share double")
    got = [set(r["errors"]) for r in quality.request_errors(df).collect()]
    assert got[0] == set()
    assert got[1] == {"avg_activity_negative", "active_hours_above_24", "peak_ratio_negative",
                      "variability_negative", "internet_share_above_1"}
    assert got[2] == {"active_hours_negative", "internet_share_negative", "activity_growth_missing"}


def test_integrity_finds_duplicates_and_nan(spark, hourly):
    table = series.feature_table(hourly(("1", START, range(1, 55))))
    assert quality.require_scorable(table) is table
    with pytest.raises(ValueError, match="duplicate_keys"):
        quality.require_scorable(table.unionByName(table.limit(1)))
    broken = table.withColumn("variability", F.lit(float("nan")))
    assert quality.feature_integrity(broken).first()["bad_variability"] == 7


def test_leakage_checks_see_a_shifted_target(hourly):
    df = hourly(("1", START, [float(i % 7) for i in range(70)]))
    labelled = series.feature_table_with_label(df)
    end = F.lit("2013-11-03 08:00:00").cast("timestamp")
    assert all(r["passed"] for r in quality.leakage_checks(labelled, df, end).collect())
    shifted = labelled.withColumn("future_total_activity", F.col("future_total_activity") + 1)
    failed = {r["check"] for r in quality.leakage_checks(shifted, df, end).collect() if not r["passed"]}
    assert "target_misaligned" in failed
    late = labelled.withColumn("feature_timestamp", F.col("prediction_timestamp"))
    failed = {r["check"] for r in quality.leakage_checks(late, df, end).collect() if not r["passed"]}
    assert {"feature_not_before_target", "target_not_next_hour"} <= failed


def test_protection_of_features(spark):
    df = spark.createDataFrame([(float("nan"), 30, 1.5), (float("inf"), -1, -0.5), (2.0, 7, None)],
                               "avg_activity double, active_hours int, internet_share double")
    got = [tuple(r) for r in clean.protect_features(df).collect()]
    assert got == [(0.0, 24, 1.0), (0.0, 0, 0.0), (2.0, 7, 0.0)]


def test_one_grid_holding_most_rows(spark):
    """A grid with most of the raw rows, many of them the same hour: sums stay right."""
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("CellID"),
        (F.to_timestamp(F.lit(START)) + F.make_dt_interval(F.lit(0), (F.col("id") % 50).cast("int"))).alias("datetime"),
        (F.col("id") % 8).cast("string").alias("countrycode"),
        *[F.lit(1.0).alias(m) for m in S.RAW_MEASURES])
    parsed = clean.parse_activity(rows)
    table = aggregate.hourly_grid(parsed)
    assert table.filter("grid_id = 'hot'").count() == 50
    assert table.agg(F.sum("total_activity")).first()[0] == 5.0 * n
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1
    assert profile.duplicate_rows(parsed).first()["duplicate_rows"] == n - parsed.distinct().count()


def test_windows_share_one_exchange(spark, hourly):
    stored = hourly(("1", START, range(60)))
    for build in (series.feature_table, series.feature_table_with_label, series.rolling_baseline,
                  anomaly.anomaly_scores, lambda h: alerts.rule_alerts(h, floor=0.0)):
        plan = build(stored)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_warehouse_checks_fail_on_a_lost_row(spark, hourly):
    source = warehouse.warehouse_source(hourly(("1", START, range(30)), ("2", START, range(30))))
    times, grids = warehouse.dim_time(source), warehouse.dim_grid(source)
    fact = warehouse.fact_activity(source, times, grids)
    assert all(r["passed"] for r in warehouse.warehouse_checks(source, grids, fact).collect())
    less = fact.filter("NOT (grid_id = '2' AND event_time = '2013-11-01 05:00:00')")
    failed = {r["name"] for r in warehouse.warehouse_checks(source, grids, less).collect() if not r["passed"]}
    assert failed == {"fact_rows_equal_source", "sums_match_source"}
    assert source.filter("sms_count <> 0 OR call_count <> 0").count() == 0  # absent columns are zero


def test_grid_sketches_by_distinct_pairs(spark):
    """Grids of a date count once, null grids not at all; a pair of date and grid has no sketch of its own."""
    rows = [(f"2024-01-{1 + i % 3:02d}", None if i % 50 == 0 else str(i % 700)) for i in range(4200)]
    hours = spark.createDataFrame(rows, "date string, grid_id string").withColumn("date", F.to_date("date"))
    made = aggregate.grid_sketches(hours)
    got = {str(r["date"]): (r["grids"], r["n"]) for r in made.withColumn("n", F.hll_sketch_estimate("grid_sketch")).collect()}
    for date in {d for d, _ in rows}:
        exact = len({g for d, g in rows if d == date and g is not None})
        assert got[date][0] == exact and got[date][1] == pytest.approx(exact, rel=0.03)
    assert "DISTINCT" not in made._jdf.queryExecution().optimizedPlan().toString().upper()
