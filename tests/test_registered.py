"""Every registered query against its SQL on the smallest folder."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, differences
from hourgrid.operators import alerts, anomaly
from hourgrid.plans import catalog
from hourgrid.plans.fixtures import Workspace

TRAINED = {"risk_scores", "request_scores", "feature_importance"}
SLOW = {"trained_evaluation"}  # 300 trees; compared by check.py and in test_trained_evaluation with few


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.comparison_sql()) - SLOW))
def test_matches_sql(spark, folder, oracle, name):
    got = catalog.registered()[name](spark, folder).toPandas()
    assert differences(got, oracle.execute(catalog.comparison_sql()[name]).df()) == ""


def test_trained_evaluation(spark, folder, oracle, monkeypatch):
    from hourgrid.operators import learning

    full = learning.fit_classifier
    monkeypatch.setattr(learning, "fit_classifier", lambda train: full(train, trees=5))
    got = catalog.registered()["trained_evaluation"](spark, folder).toPandas()
    assert differences(got, oracle.execute(catalog.comparison_sql()["trained_evaluation"]).df()) == ""


def test_only_trained_queries_have_no_sql():
    rest = set(catalog.registered()) - set(catalog.comparison_sql()) - TRAINED
    assert rest == set()


@pytest.mark.parametrize("name", ["hotspots_asof", "top_movers", "attention_top20", "top_grids_geo"])
def test_top_rows_are_broadcast_to_the_table(spark, folder, name):
    """The large side of a top-k result is neither exchanged nor sorted for the join."""
    plan = catalog.registered()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "RightOuter" not in plan


COMPOSITE = ["fact_activity", "wh_top_grids", "alerts_asof", "three_way_comparison", "top_movers", "explain_grid", "hotspots_asof",
             "rule_alerts", "alert_summary", "alerts_by_type", "latest_alert_per_grid", "above_floor_rows"]


@pytest.mark.parametrize("name", COMPOSITE)
def test_raw_events_are_read_once(spark, folder, name):
    """Composite queries write the hourly table first; their own plan reads no raw events."""
    plan = catalog.registered()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_type") == 0


def test_joins_and_windows_use_the_layout_by_grid(spark, folder):
    """With a given floor, alerts and the three-way comparison over the stored hourly table exchange nothing."""
    ws = Workspace(spark, folder).stored
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        ruled = alerts.rule_alerts(ws.hourly, 5.0)
        for df in (ruled, anomaly.three_way_comparison(ws.predictions, ws.scores, ruled)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Window" in plan and "Bucketed: true" in plan and "Exchange" not in plan
        assert "SortMergeJoin" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_evidence_computes_features_once(spark, folder):
    """Three parts of a record need features; they read them as stored, and no plan repeats their windows."""
    plan = catalog.registered()["evidence_package"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stddev_pop") == 0
