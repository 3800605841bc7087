"""Registered queries: reports at an as-of time, and run records."""

from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import (
    aggregate, anomaly as AN, clean, learning, profile, runs, series, serving as V,
)
from hourgrid.plans.fixtures import VERSION
from hourgrid.plans.oracle import R, T, rounded, trailing_mean
from hourgrid.session import stored, stored_by

# Fixed value: the moment reports are read, the day after the last test event.
NOW = "2024-01-31 12:00:00"
_POINT = f"""{R('sms_count')} AS sms_activity, {R('call_count')} AS call_activity,
    {R('internet_volume')} AS internet_activity, {R('total')} AS total_activity"""
_RISK = f"{R('r.risk_score')} AS risk_score, r.risk_level, r.model_version"
_AT = "(SELECT as_of FROM latest)"
_TIMELINE = f"""SELECT f.*, r.risk_score, r.risk_level, r.model_version FROM (SELECT *, row_number() OVER
    (PARTITION BY grid_id ORDER BY event_time DESC) AS newest FROM fact) f
    LEFT JOIN risk r ON r.grid_id = f.grid_id AND r.timestamp = f.event_time WHERE f.newest <= 168"""
_LEVELS = ["HIGH", "ATTENTION", "LOW"]


def _cast(df, **types):
    return df.withColumns({n: F.col(n).cast(t) for n, t in types.items()})


def _counts(col, name, levels):
    return ", ".join(f"count(*) FILTER ({col} = '{v}') AS {name}_{v.lower()}" for v in levels)


def _record(ws):
    """The publication record of a run over the corrupted rows."""
    nulls = profile.null_profile(ws.corrupted, S.MEASURES).select("null_total").scalar()
    kept, _ = clean.split_rejects(ws.corrupted)
    hourly = aggregate.hourly_grid(kept, scale=4)
    published = aggregate.grain_check(hourly).select(
        F.struct("rows", "passed").alias("p")
    ).scalar()
    counts = clean.reject_counts(ws.corrupted).select(
        F.col("raw_rows").alias("rows_in"), "rejected_rows", "balanced",
        F.col("rejected_rows").alias("rows_rejected"),
    ).withColumns({
        "nulls_handled": nulls, "rows_published": published.getField("rows"),
        "unique": published.getField("passed"),
        "as_of": hourly.agg(F.max("timestamp").alias("t")).scalar(),
    })
    checks = {
        "processed_activity_exists": F.col("rows_in") > F.col("rows_rejected"),
        "hourly_summary_exists": F.col("rows_published") > 0,
        "dashboard_summary_exists": F.col("unique"),
        "warehouse_exists": F.col("balanced"),
    }
    return runs.publication_record(counts, checks, "activity", "manual__1", NOW)


def _day_records(ws):
    """One status record per day; days with many rejects count as failed runs."""
    marked = ws.corrupted.filter("timestamp IS NOT NULL").withColumns({
        "_bad": clean.reject_reason().isNotNull().cast("int"), "date": F.to_date("timestamp"),
    })
    days = marked.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows_in"), F.sum("_bad").alias("rows_rejected"),
        F.max("timestamp").alias("last"),
    )
    few = F.col("rows_rejected") * 50 < F.col("rows_in")
    some = F.col("rows_rejected") * 40 < F.col("rows_in")
    return days.select(
        F.when(few | some, "SUCCESS").otherwise("FAILED").alias("status"),
        F.date_format("date", "yyyy-MM-dd").alias("run_id"),
        F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("as_of"),
        F.when(few, "PASS").otherwise("FAIL").alias("quality_check"),
        F.when(~(few | some), "load_warehouse").alias("failed_task"),
        "rows_in", "rows_rejected", F.lit(0).cast("bigint").alias("nulls_handled"),
        (F.col("rows_in") - F.col("rows_rejected")).alias("rows_published"),
        F.create_map(F.lit("hourly_summary_exists"), F.lit(True),
                     F.lit("warehouse_exists"), few | some).alias("checks"),
    )


_DAY_SQL = """SELECT strftime(d, '%Y-%m-%d') AS run_id, n, b, last, b * 50 < n AS few, (b * 50 < n OR b * 40 < n) AS fair
    FROM (SELECT CAST(timestamp AS DATE) AS d, count(*) AS n, count(reject_reason) AS b, max(timestamp) AS last
          FROM bad WHERE timestamp IS NOT NULL GROUP BY 1) q"""


def _hours_between(ts):
    return f"(epoch(TIMESTAMP '{NOW}') - floor(epoch({ts}))) / 3600.0::DOUBLE"


def _tasks(df):
    return df.select("last_run_id", *[
        F.element_at("task_status", t).alias(t) for t in S.PIPELINE_TASKS])


QUERIES = {
    "network_summary": (
        lambda ws: V.network_summary(ws.stored.fact),
        f"""SELECT {R('t')} AS total_activity, g AS active_grids, {T('p')} AS peak_hour, top AS top_grid,
            {T(_AT)} AS as_of FROM (SELECT sum(total) AS t, count(DISTINCT CASE WHEN total > 0 THEN grid_id END) AS g,
            (SELECT event_time FROM fact GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 1) AS p,
            (SELECT grid_id FROM fact GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 1) AS top FROM fact) s"""),
    "network_summary_at": (
        lambda ws: V.network_summary(ws.stored.fact, "2024-01-15 12:00:00").drop("as_of"),
        f"""SELECT {R('t')} AS total_activity, g AS active_grids, {T('p')} AS peak_hour, top AS top_grid
            FROM (SELECT sum(total) AS t, count(DISTINCT CASE WHEN total > 0 THEN grid_id END) AS g,
            (SELECT event_time FROM fact WHERE event_time <= '2024-01-15 12:00:00' GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 1) AS p,
            (SELECT grid_id FROM fact WHERE event_time <= '2024-01-15 12:00:00' GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT 1) AS top
            FROM fact WHERE event_time <= '2024-01-15 12:00:00') s"""),
    "grid_drilldown": (
        lambda ws: V.grid_drilldown(ws.stored.fact),
        f"""SELECT grid_id, {T('event_time')} AS timestamp, {_POINT} FROM fact
            WHERE event_time BETWEEN {_AT} - INTERVAL 23 HOURS AND {_AT}"""),
    "grid_timeline": (
        lambda ws: V.grid_timeline(ws.stored.fact, ws.stored.risk),
        f"""SELECT f.grid_id, {T('f.event_time')} AS timestamp, {_POINT}, {_RISK} FROM (SELECT *, row_number() OVER
            (PARTITION BY grid_id ORDER BY event_time DESC) AS newest FROM fact) f
            LEFT JOIN risk r ON r.grid_id = f.grid_id AND r.timestamp = f.event_time WHERE f.newest <= 168"""),
    "timeline_summary": (
        lambda ws: V.timeline_summary(V.grid_timeline(ws.stored.fact, ws.stored.risk)).drop("risk_levels"),
        f"""SELECT grid_id, count(*) AS points, {T('min(event_time)')} AS period_start, {T('max(event_time)')} AS period_end,
            {R('min(total)')} AS minimum_total_activity, {R('max(total)')} AS maximum_total_activity,
            {R('avg(total)')} AS average_total_activity, {R('min(risk_score)')} AS risk_score_min,
            {R('max(risk_score)')} AS risk_score_max, {_counts('risk_level', 'risk', _LEVELS)}
            FROM ({_TIMELINE}) t GROUP BY 1"""),
    "alert_history_summary": (
        lambda ws: V.alert_history_summary(ws.alerts).drop("severity_counts"),
        f"""SELECT grid_id, count(*) AS alert_count, {_counts('severity', 'severity', S.SEVERITIES)},
            {T('min(timestamp)')} AS first_alert, {T('max(timestamp)')} AS last_alert FROM alerts GROUP BY 1"""),
    "hotspots_asof": (
        lambda ws: V.hotspots(ws.stored.fact, ws.stored.risk).drop("reason"),
        f"""SELECT h.grid_id, {T('h.event_time')} AS timestamp, {_POINT}, CASE WHEN total > 0 THEN 'ACTIVE' ELSE 'NORMAL' END AS status,
            {_RISK} FROM (SELECT * FROM fact WHERE event_time = {_AT} ORDER BY total DESC, grid_id LIMIT 10) h
            LEFT JOIN risk r ON r.grid_id = h.grid_id AND r.timestamp = h.event_time"""),
    "alerts_asof": (
        lambda ws: V.alert_listing(ws.stored.alerts, ws.stored.risk, ws.stored.as_of).drop("reason"),
        f"""SELECT a.grid_id, {T('a.timestamp')} AS timestamp, {R('cur')} AS total_activity, severity,
            alert_type AS status, {_RISK} FROM last_alert a LEFT JOIN risk r ON r.grid_id = a.grid_id AND r.timestamp = a.timestamp"""),
    "all_alerts_listing": (
        lambda ws: V.alert_listing(ws.stored.alerts, ws.stored.risk, ws.stored.as_of, latest_only=False, order="text").drop("reason"),
        f"""SELECT a.grid_id, {T('a.timestamp')} AS timestamp, {R('cur')} AS total_activity, severity,
            alert_type AS status, {_RISK} FROM alerts a LEFT JOIN risk r ON r.grid_id = a.grid_id AND r.timestamp = a.timestamp"""),
    "top_movers": (
        lambda ws: V.top_movers(ws.stored.features, ws.stored.risk, ws.stored.scores, ws.stored.as_of),
        f"""SELECT m.grid_id, {T('m.feature_timestamp')} AS timestamp, {R('m.avg_activity')} AS avg_activity,
            {R('m.activity_growth')} AS activity_growth, {R('m.fl')} AS activity_floor, {_RISK},
            {R('a.anomaly_score')} AS anomaly_score, a.anomaly_direction
            FROM (SELECT * FROM (SELECT *, (SELECT quantile_cont(avg_activity, 0.1) FROM wfeat
                    WHERE feature_timestamp = {_AT}) AS fl
                  FROM wfeat WHERE feature_timestamp = {_AT}) x
                  WHERE avg_activity >= fl ORDER BY activity_growth DESC, grid_id LIMIT 10) m
            LEFT JOIN risk r ON r.grid_id = m.grid_id AND r.timestamp = m.feature_timestamp
            LEFT JOIN anomalies a ON a.grid_id = m.grid_id AND a.timestamp = m.feature_timestamp"""),
    "grid_location": (
        lambda ws: V.grid_location(ws.dim_grid),
        f"""SELECT grid_id, {rounded('centroid_latitude', 'centroid_longitude')},
            geometry_reference AS polygon_reference FROM dim_grid"""),
    "map_status": (
        lambda ws: V.map_status(V.hotspots(ws.stored.fact, ws.stored.risk), ws.stored.alerts).select(
            "grid_id", "total_activity", "alert_timestamp", "operational_status"),
        f"""SELECT h.grid_id, {R('h.total')} AS total_activity, {T('a.timestamp')} AS alert_timestamp,
            CASE a.severity WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'ATTENTION' ELSE 'NORMAL' END AS operational_status
            FROM (SELECT * FROM fact WHERE event_time = {_AT} ORDER BY total DESC, grid_id LIMIT 10) h
            LEFT JOIN last_alert a ON a.grid_id = h.grid_id"""),
    "explain_grid": (
        lambda ws: V.explain_grids(ws.stored.fact, ws.stored.risk, ws.stored.scores, ws.stored.dim_grid).drop(
            "severity_reason", "next_checks"),
        f"""SELECT g.grid_id, {T('g.event_time')} AS timestamp, {R('g.total')} AS current_activity, {R('base')} AS baseline_activity,
            {R('ratio')} AS activity_ratio, {R('rs')} AS ml_risk_score, {R('anomaly_score')} AS anomaly_score,
            {rounded('centroid_latitude', 'centroid_longitude')},
            CASE WHEN ratio > 1.5 OR coalesce(rs, 0) > 0.7 THEN 'high' WHEN ratio > 1.2 OR coalesce(rs, 0) > 0.4 THEN 'medium'
              ELSE 'low' END AS severity,
            'Grid ' || g.grid_id || ' shows ' || CASE WHEN ratio > 1.2 THEN 'elevated' ELSE 'normal' END
              || ' activity relative to baseline. ML model ' || CASE WHEN coalesce(rs, 0) > 0.5 THEN 'indicates'
              ELSE 'does not indicate' END || ' high-activity risk.' AS interpretation
            FROM (SELECT f.*, b.base, CASE WHEN b.base > 0 THEN f.total / b.base ELSE 1.0::DOUBLE END AS ratio,
                    r.risk_score AS rs, a.anomaly_score, d.centroid_latitude, d.centroid_longitude
                  FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY event_time DESC) AS rn FROM fact) f
                  JOIN (SELECT f.grid_id, coalesce(avg(h.total), 0.0) AS base FROM (SELECT grid_id, max(event_time) AS last
                          FROM fact GROUP BY 1) f LEFT JOIN fact h ON h.grid_id = f.grid_id AND h.event_time < f.last
                          AND h.event_time > f.last - INTERVAL 7 DAYS GROUP BY 1) b ON b.grid_id = f.grid_id
                  LEFT JOIN risk r ON r.grid_id = f.grid_id AND r.timestamp = f.event_time
                  LEFT JOIN anomalies a ON a.grid_id = f.grid_id AND a.timestamp = f.event_time
                  LEFT JOIN dim_grid d ON d.grid_id = f.grid_id WHERE f.rn = 1) g"""),
    "review_anomaly": (
        lambda ws: _cast(V.review_anomalies(ws.stored.fact, ws.stored.risk, ws.stored.scores).select(
            *S.KEYS, "total_activity", "baseline_activity", "rule_triggered", "classifier_positive",
            "anomaly_elevated", "agreement", "anomaly_side", "disagreement_analysis"),
            classifier_positive="string", anomaly_elevated="string", agreement="string"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R('total_activity')} AS total_activity, {R('b')} AS baseline_activity,
            rule AS rule_triggered, CAST(model AS VARCHAR) AS classifier_positive, CAST(odd AS VARCHAR) AS anomaly_elevated,
            CAST(rule = model AND rule = odd AND model IS NOT NULL AND odd IS NOT NULL AS VARCHAR) AS agreement_raw,
            CASE WHEN s > 0 THEN 'above_baseline' WHEN s < 0 THEN 'below_baseline' ELSE 'neutral' END AS anomaly_side,
            CASE WHEN model IS NULL OR odd IS NULL OR (rule = model AND rule = odd) THEN 'All signals agree' ELSE
              CASE WHEN rule <> model THEN 'Rule alert (' || rule || ') differs from classifier (' || model || '). ' ELSE '' END
              || CASE WHEN rule <> odd THEN 'Rule alert (' || rule || ') differs from anomaly (' || odd || '). ' ELSE '' END
            END AS disagreement_analysis
            FROM (SELECT q.*, q.total_activity > b * 1.5::DOUBLE AS rule, r.risk_score > 0.5 AS model, a.anomaly_score > 1.5 AS odd,
                    a.anomaly_score AS s FROM (SELECT grid_id, event_time AS timestamp, total AS total_activity,
                      coalesce({trailing_mean('event_time').replace('total_activity', 'total')}, 0.0) AS b FROM fact) q
                  LEFT JOIN risk r ON r.grid_id = q.grid_id AND r.timestamp = q.timestamp
                  LEFT JOIN anomalies a ON a.grid_id = q.grid_id AND a.timestamp = q.timestamp) z""".replace(
            "CAST(rule = model AND rule = odd AND model IS NOT NULL AND odd IS NOT NULL AS VARCHAR) AS agreement_raw",
            "CAST(CASE WHEN model IS NOT NULL AND odd IS NOT NULL THEN rule = model AND rule = odd END AS VARCHAR) AS agreement")),
    "evidence_point": (
        lambda ws: _cast(V.evidence_points(ws.stored.fact, ws.stored.features, ws.stored.scores), anomaly_flag="bigint"),
        f"""SELECT f.grid_id, {T('f.event_time')} AS timestamp, {R('f.total')} AS current_activity,
            {rounded('avg_activity', 'activity_growth', 'peak_ratio', 'variability', prefix='w.')},
            {rounded('baseline_activity', 'anomaly_score', prefix='a.')}, a.anomaly_direction,
            CAST(a.anomaly_flag AS BIGINT) AS anomaly_flag FROM fact f
            LEFT JOIN wfeat w ON w.grid_id = f.grid_id AND w.feature_timestamp = f.event_time
            LEFT JOIN anomalies a ON a.grid_id = f.grid_id AND a.timestamp = f.event_time"""),
    "evidence_package_fields": (
        lambda ws: _packages(ws.stored).select(
            "grid_id",
            F.col("current_interval_metrics.total_activity").alias("current_activity"),
            F.col("grid_features.avg_activity").alias("avg_activity"),
            F.col("location.polygon_reference").alias("polygon_reference"),
            F.col("recent_history_summary.points").alias("points"),
            F.col("prior_alert_summary.last_alert").alias("last_alert"),
            F.col("current_model_risk.risk_level").alias("risk_level"),
            F.col("current_anomaly.anomaly_direction").alias("anomaly_direction")),
        f"""SELECT g.grid_id, {R('c.total')} AS current_activity, {R('w.avg_activity')} AS avg_activity,
            g.geometry_reference AS polygon_reference, least(n.n, 168) AS points, {T('a.timestamp')} AS last_alert,
            r.risk_level, x.anomaly_direction
            FROM dim_grid g
            JOIN (SELECT grid_id, count(*) AS n FROM fact GROUP BY 1) n ON n.grid_id = g.grid_id
            LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY event_time DESC) AS rn FROM fact
              WHERE event_time >= {_AT} - INTERVAL 23 HOURS) c ON c.grid_id = g.grid_id AND c.rn = 1
            LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY feature_timestamp DESC) AS rn FROM wfeat) w
              ON w.grid_id = g.grid_id AND w.rn = 1
            LEFT JOIN last_alert a ON a.grid_id = g.grid_id
            LEFT JOIN risk r ON r.grid_id = g.grid_id AND r.timestamp = {_AT}
            LEFT JOIN anomalies x ON x.grid_id = g.grid_id AND x.timestamp = {_AT}"""),
    "evidence_package": (lambda ws: _read_back(V.evidence_json(_packages(ws.stored))), None),
    "latest_features": (
        lambda ws: V.latest_features(ws.features).select("grid_id", "feature_timestamp", "avg_activity"),
        f"""SELECT grid_id, {T('max(feature_timestamp)')} AS feature_timestamp,
            {R('max_by(avg_activity, feature_timestamp)')} AS avg_activity FROM wfeat GROUP BY 1"""),
    "freshness": (
        lambda ws: runs.grid_freshness(ws.fact, NOW),
        f"""SELECT grid_id, {T('t')} AS last_event, CASE WHEN {_hours_between('t')} <= 24 THEN 'FRESH'
            WHEN {_hours_between('t')} <= 72 THEN 'STALE' ELSE 'VERY_STALE' END AS freshness
            FROM (SELECT grid_id, max(event_time) AS t FROM fact GROUP BY 1) s"""),
    "warehouse_health": (
        lambda ws: runs.warehouse_health(
            ws.stored.fact, clean.split_rejects(ws.stored.corrupted)[1], NOW
        ).withColumn("rejected_reasons", F.array_join("rejected_reasons", ",")),
        f"""SELECT {T('t')} AS last_run, n AS warehouse_rows, CASE WHEN h < 24 THEN 'healthy' WHEN h < 72 THEN 'warning'
            ELSE 'failure' END AS status, {R('h')} AS staleness_hours, b AS rejected_rows, rs AS rejected_reasons,
            CASE WHEN n > 0 THEN 'operational' ELSE 'no_data' END AS warehouse_state,
            CASE WHEN b = 0 THEN 'good' ELSE 'issues' END AS data_quality_state
            FROM (SELECT max(event_time) AS t, count(*) AS n, {_hours_between('max(event_time)')} AS h,
              (SELECT count(reject_reason) FROM bad) AS b,
              (SELECT string_agg(DISTINCT reject_reason, ',' ORDER BY reject_reason) FROM bad) AS rs FROM fact) s"""),
    "publication_record": (
        lambda ws: _record(ws.stored).select(
            "status", "healthy", "as_of", "quality_check", "rows_in", "rows_rejected", "nulls_handled",
            "rows_published", F.size("reasons").cast("bigint").alias("failed_checks")),
        """SELECT 'SUCCESS' AS status, true AS healthy, strftime(t, '%Y-%m-%dT%H:%M:%S') AS as_of, 'PASS' AS quality_check,
            n AS rows_in, b AS rows_rejected, z AS nulls_handled, p AS rows_published, CAST(0 AS BIGINT) AS failed_checks
            FROM (SELECT count(*) AS n, count(reject_reason) AS b,
              5 * count(*) - count(sms_in) - count(sms_out) - count(call_in) - count(call_out) - count(internet_activity) AS z,
              (SELECT count(*) FROM (SELECT DISTINCT grid_id, date_trunc('hour', timestamp) FROM bad
                WHERE reject_reason IS NULL) d) AS p,
              (SELECT date_trunc('hour', max(timestamp)) FROM bad WHERE reject_reason IS NULL) AS t FROM bad) s"""),
    "run_status": (
        lambda ws: runs.run_status(_day_records(ws), NOW).drop("task_status").withColumn(
            "reasons", F.array_join("reasons", "; ")),
        f"""SELECT run_id AS last_run_id, {T('last')} AS last_run_timestamp, n AS rows_in, b AS rows_rejected,
            CAST(0 AS BIGINT) AS nulls_handled, n - b AS rows_published, {T('last')} AS as_of,
            CASE WHEN {_hours_between('last')} <= 24 THEN 'FRESH' WHEN {_hours_between('last')} <= 72 THEN 'STALE'
              ELSE 'VERY_STALE' END AS freshness, few AS healthy,
            concat_ws('; ', CASE WHEN NOT fair THEN 'Pipeline status is FAILED' END,
              CASE WHEN NOT few THEN 'Quality check status is FAIL' END,
              CASE WHEN NOT fair THEN 'Failed task: load_warehouse' END) AS reasons FROM ({_DAY_SQL}) r"""),
    "run_tasks": (
        lambda ws: _tasks(runs.run_status(_day_records(ws), NOW)),
        f"""SELECT run_id AS last_run_id, CASE WHEN few THEN 'SUCCESS' ELSE 'UNKNOWN' END AS ingest,
            CASE WHEN few THEN 'SUCCESS' ELSE 'UNKNOWN' END AS validate, 'SUCCESS' AS spark_process,
            CASE WHEN fair THEN 'SUCCESS' ELSE 'FAILED' END AS load_warehouse,
            CASE WHEN few THEN 'SUCCESS' ELSE 'FAILED' END AS quality_check,
            CASE WHEN few THEN 'SUCCESS' ELSE 'UNKNOWN' END AS notify FROM ({_DAY_SQL}) r"""),
    "attention_top20": (
        lambda ws: _cast(V.attention_report(ws.stored.risk, ws.stored.features, VERSION).drop("reason"), rank="bigint"),
        f"""SELECT t.rank, t.grid_id, {T('t.timestamp')} AS timestamp, {R('t.risk_score')} AS risk_score, t.risk_level,
            t.model_version, {rounded('avg_activity', 'activity_growth', 'peak_ratio', 'variability', 'internet_share', prefix='w.')}
            FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, timestamp DESC, grid_id) AS rank FROM risk) t
            LEFT JOIN wfeat w ON w.grid_id = t.grid_id AND w.feature_timestamp = t.timestamp WHERE t.rank <= 20"""),
    # --- trained model: no exact SQL, results are checked in the tests
    "risk_scores": (lambda ws: _model_scores(ws.stored)[1], None),
    "request_scores": (lambda ws: _request_scores(ws.stored), None),
    "trained_evaluation": (
        lambda ws: _trained_evaluation(ws.stored),
        """SELECT count(*) AS rows, count(*) FILTER (high = 1) AS positives, true AS auc_agrees, true AS sweep_agrees,
            true AS two_way_adds_up, true AS three_way_adds_up, true AS actual_rate_agrees, true AS predicted_rate_agrees
            FROM labelled CROSS JOIN train_end e WHERE prediction_timestamp > e.train_end"""),
    "feature_importance": (lambda ws: learning.feature_importance(_model(ws.stored)), None),
}


def _read_back(written):
    """Fields of the JSON records, read from their text."""
    def field(path, kind="string"):
        return F.get_json_object("package", f"$.{path}").cast(kind)

    return written.select(
        "grid_id", field("current_interval_metrics.total_activity", "double").alias("current_activity"),
        field("grid_features.avg_activity", "double").alias("avg_activity"),
        field("location.polygon_reference").alias("polygon_reference"),
        field("recent_history_summary.points", "bigint").alias("points"),
        field("prior_alert_summary.last_alert", "timestamp").alias("last_alert"),
        field("current_model_risk.risk_level").alias("risk_level"),
        field("current_anomaly.anomaly_direction").alias("anomaly_direction"))


def _packages(ws):
    """Features stand behind three parts of a record, so their windows are computed once."""
    features = stored_by(ws.features, "features", "grid_id", ("feature_timestamp",))
    return V.evidence_packages(
        ws.fact, features, ws.dim_grid, ws.risk_of(features), ws.scores, ws.alerts, _record(ws)
    )


def _model(ws):
    """Trained on the earlier part of the labelled rows."""
    train, _ = learning.chronological_split(ws.labelled, ws.train_end)
    return learning.fit_classifier(train)


def _trained_evaluation(ws):
    """Sweep, AUC, bias and agreements of the trained model on the later part of the labelled rows.

    The figures depend on the trainer; the columns that SQL can state are counts and the relations that must hold.
    """
    _, test = learning.chronological_split(ws.labelled, ws.train_end)
    scored = stored(learning.with_probability(_model(ws), test), "test_scores")
    sweep = learning.threshold_sweep(scored)
    picked = learning.best_threshold(sweep).select("threshold").scalar()
    predicted = stored(learning.with_prediction(scored, picked), "test_predictions")
    rows, high = F.col("rows"), F.col("positives")
    area = learning.auc(scored).select("auc").scalar()
    again = F.lit(learning.evaluator_auc(scored))
    two = AN.category_counts(AN.two_way_agreement(predicted, ws.alerts), "agreement_category", S.AGREEMENT)
    three = AN.category_counts(AN.three_way_comparison(predicted, ws.scores, ws.alerts), "comparison_category", S.COMPARISON)
    rates = learning.prediction_bias(predicted)
    chosen = predicted.agg(F.sum("MODEL_PREDICTION")).scalar()
    best = learning.best_threshold(sweep).select(F.col("tp") + F.col("fp")).scalar()
    actual = rates.select("actual_rate").scalar()
    guessed = rates.select("predicted_rate").scalar()
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("HIGH_ACTIVITY") == 1).alias("positives")).select(
        "rows", "positives",
        # The trainer's own figure is not defined without both classes.
        ((high == 0) | (high == rows) | (F.abs(area - again) < 1e-6)).alias("auc_agrees"),
        (best == chosen).alias("sweep_agrees"),
        (two.agg(F.sum("rows")).scalar() == rows).alias("two_way_adds_up"),
        (three.agg(F.sum("rows")).scalar() == rows).alias("three_way_adds_up"),
        (F.abs(actual * rows - high) < 1e-6).alias("actual_rate_agrees"),
        (F.abs(guessed * rows - chosen) < 1e-6).alias("predicted_rate_agrees"))


def _model_scores(ws):
    model = _model(ws)
    rows = learning.batch_score(
        model, series.feature_windows(ws.hourly), series.temporal_features(ws.hourly), "gbt-v1"
    )
    return model, rows


def _request_scores(ws):
    return learning.score_requests(_model(ws), series.feature_windows(ws.hourly), ws.hourly, "gbt-v1")




QUERIES["evidence_package"] = (QUERIES["evidence_package"][0], QUERIES["evidence_package_fields"][1])
