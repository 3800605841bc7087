"""Registered queries: alerts, anomalies, warehouse, learning, files and text."""

from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.functions.quantiles import bucket_median, leave_one_out_median
from hourgrid.operators import (
    alerts as AL, anomaly as AN, gates, grounding, learning as L, quality as Q, series,
    warehouse as WH,
)
from hourgrid.plans import fixtures as FX
from hourgrid.plans.oracle import D, MEASURES, R, T, ratio, rounded
from hourgrid.sources.sinks import merge_scores

X = "total_activity"
_ALERT = f"grid_id, {T('timestamp')} AS timestamp, alert_type, {R('cur')} AS current_activity, {R('base')} AS baseline_activity"


def _cast(df, **types):
    return df.withColumns({n: F.col(n).cast(t) for n, t in types.items()})


def _values(pairs):
    return "(VALUES " + ", ".join(f"('{v}', {i})" for i, v in enumerate(pairs)) + ") v(name, i)"


_NUMBER = "[0-9]+(?:[.][0-9]+)?"
# Which number of a text shows which column.
_AROUND = {1: "current_activity", 3: "baseline_activity"}
_SCORED = {1: "total_activity", 3: "baseline_activity"}


def _texts(df, shown, kind):
    """The texts with every number as #, and whether the numbers are those of the row (to the digits shown)."""
    numbers = F.regexp_extract_all("reason", F.lit(f"({_NUMBER})"), F.lit(1))
    agree = F.lit(True)
    for value, places in shown.items():
        for place, column in places.items():
            near = F.abs(F.element_at("_n", place).cast("double") - F.col(column)) <= 0.0051
            agree &= F.when(F.col(kind) == value, near).otherwise(True)
    return df.withColumn("_n", numbers).withColumns({
        "wording": F.regexp_replace("reason", _NUMBER, "#"), "numbers_agree": F.coalesce(agree, F.lit(False))})


QUERIES = {
    # --- baselines and alerts
    "loo_median_day": (
        lambda ws: leave_one_out_median(
            ws.hourly.select(*S.KEYS, "date", X), ["grid_id", "date"], X, "baseline_activity"
        ).select(*S.KEYS, "baseline_activity"),
        f"SELECT grid_id, {T('timestamp')} AS timestamp, {R('baseline_activity')} AS baseline_activity FROM loo_day"),
    "loo_median_hour": (
        lambda ws: leave_one_out_median(
            ws.hourly.select(*S.KEYS, X, F.hour("timestamp").alias("h")), ["grid_id", "h"], X,
            "baseline_activity").select(*S.KEYS, "baseline_activity"),
        f"SELECT grid_id, {T('timestamp')} AS timestamp, {R('baseline_activity')} AS baseline_activity FROM loo_hour"),
    "bucket_median": (
        lambda ws: bucket_median(
            ws.hourly.select(*S.KEYS, "date", X), ["grid_id", "date"], X, "day_median"
        ).select(*S.KEYS, "day_median"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R('m')} AS day_median FROM (
            SELECT *, median(total_activity) OVER (PARTITION BY grid_id, date) AS m FROM hourly) s"""),
    "activity_floor": (
        lambda ws: AL.activity_floor(ws.hourly),
        f"SELECT {R('activity_floor')} AS activity_floor FROM floor"),
    "above_floor_rows": (
        lambda ws: AL.above_floor_rows(ws.stored.hourly).select(
            *S.KEYS, "daily_total_activity", "above_activity_floor"),
        f"""SELECT h.grid_id, {T('h.timestamp')} AS timestamp, {R('d.day_total')} AS daily_total_activity,
            d.day_total >= (SELECT activity_floor FROM floor) AS above_activity_floor
            FROM hourly h JOIN days d ON d.grid_id = h.grid_id AND d.date = h.date"""),
    "rule_alerts": (
        lambda ws: ws.stored.alerts.drop("reason"), f"SELECT {_ALERT} FROM alerts"),
    "rule_alert_reasons": (
        lambda ws: _texts(ws.stored.alerts, {"ACTIVITY_SPIKE": {2: "current_activity"}, "HIGH_ACTIVITY": _AROUND, "ACTIVITY_DROP": _AROUND},
                          "alert_type").select(*S.KEYS, "alert_type", "wording", "numbers_agree"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, alert_type, CASE alert_type
            WHEN 'HIGH_ACTIVITY' THEN 'Current activity # is at least #x the within-day baseline #.'
            WHEN 'ACTIVITY_SPIKE' THEN 'Activity increased from # to #, at least #x the previous hour.'
            ELSE 'Current activity # is at or below #x the within-day baseline #.' END AS wording, true AS numbers_agree FROM alerts"""),
    "alert_summary": (
        lambda ws: AL.alert_summary(ws.stored.alerts, ws.stored.hourly),
        f"""SELECT a AS alerts, k AS alerting_grid_hours, n AS grid_hours, {R(ratio('k', 'n'))} AS alerting_rate
            FROM (SELECT (SELECT count(*) FROM alerts) AS a, (SELECT count(*) FROM alert_keys) AS k,
                  (SELECT count(*) FROM hourly) AS n) s"""),
    "alerts_by_type": (
        lambda ws: AN.category_counts(ws.stored.alerts, "alert_type", S.ALERT_TYPES, "alerts"),
        f"""SELECT name AS alert_type, count(a.rule) AS alerts FROM {_values(S.ALERT_TYPES)}
            LEFT JOIN alerts a ON a.alert_type = v.name GROUP BY 1"""),
    "alerts_top_grids": (
        lambda ws: AL.top_alerting_grids(ws.stored.alerts),
        "SELECT grid_id, count(*) AS alerts FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "latest_alert_per_grid": (
        lambda ws: AL.latest_per_grid(ws.stored.alerts, ws.stored.as_of).drop("reason"),
        f"SELECT {_ALERT} FROM last_alert"),
    # --- anomalies
    "anomaly_scores": (
        lambda ws: _cast(ws.scores.drop("reason"), hour_of_day="bigint", anomaly_flag="bigint"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R(X)} AS total_activity, hour_of_day,
            {R('baseline_activity')} AS baseline_activity, {R('anomaly_score')} AS anomaly_score, anomaly_direction,
            CAST(anomaly_flag AS BIGINT) AS anomaly_flag FROM anomalies"""),
    "anomaly_reasons": (
        lambda ws: _texts(ws.scores.withColumn("kind", F.when(F.col("baseline_activity").isNull(), "NONE").otherwise(
            F.col("anomaly_direction"))), {"HIGH": _SCORED, "LOW": _SCORED, "NORMAL": _SCORED, "NONE": {}}, "kind").select(
                *S.KEYS, "wording", "numbers_agree"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, CASE WHEN baseline_activity IS NULL THEN 'No historical baseline available.'
            WHEN anomaly_direction = 'HIGH' THEN 'Activity # is #% above the hour-of-day baseline (#).'
            WHEN anomaly_direction = 'LOW' THEN 'Activity # is #% below the hour-of-day baseline (#).'
            ELSE 'Activity # is within the ±#% normal range around the baseline (#).' END AS wording, true AS numbers_agree FROM anomalies"""),
    "anomaly_direction_counts": (
        lambda ws: AN.category_counts(ws.scores, "anomaly_direction", S.DIRECTIONS),
        f"""SELECT name AS anomaly_direction, count(a.grid_id) AS rows FROM {_values(S.DIRECTIONS)}
            LEFT JOIN anomalies a ON a.anomaly_direction = v.name GROUP BY 1"""),
    "history_depth": (
        lambda ws: _cast(AN.history_depth(ws.hourly), hour_of_day="bigint"),
        "SELECT grid_id, hour_of_day, count(*) AS history_count FROM hourly GROUP BY 1, 2"),
    "history_summary": (
        lambda ws: AN.history_summary(ws.hourly),
        f"""SELECT count(*) AS buckets, min(n) AS min_history, max(n) AS max_history, {R('avg(n)')} AS avg_history
            FROM (SELECT count(*) AS n FROM hourly GROUP BY grid_id, hour_of_day) s"""),
    "anomaly_sanity": (
        lambda ws: AN.anomaly_sanity(ws.scores),
        """SELECT n AS min_history, k AS singleton_buckets, h AS high_rows, l AS low_rows, n > 1 AS depth_ok,
            h > 0 AND l > 0 AS directions_ok FROM (SELECT
              (SELECT min(c) FROM (SELECT count(*) AS c FROM hourly GROUP BY grid_id, hour_of_day) q) AS n,
              (SELECT count(*) FROM (SELECT count(*) AS c FROM hourly GROUP BY grid_id, hour_of_day) q WHERE c = 1) AS k,
              count(*) FILTER (anomaly_direction = 'HIGH') AS h, count(*) FILTER (anomaly_direction = 'LOW') AS l
              FROM anomalies) s"""),
    "two_way_agreement": (
        lambda ws: _cast(AN.two_way_agreement(ws.stored.predictions, ws.stored.alerts).select(
            "grid_id", "prediction_timestamp", "MODEL_PREDICTION", "NP3_ALERT", "agreement_category"),
            MODEL_PREDICTION="bigint", NP3_ALERT="bigint"),
        f"""SELECT grid_id, {T('prediction_timestamp')} AS prediction_timestamp, CAST(pred AS BIGINT) AS MODEL_PREDICTION,
            CAST(rule AS BIGINT) AS NP3_ALERT, CASE WHEN pred = 1 AND rule = 1 THEN 'MODEL_AND_NP3'
            WHEN pred = 1 THEN 'MODEL_ONLY' WHEN rule = 1 THEN 'NP3_ONLY' ELSE 'NEITHER' END AS agreement_category
            FROM compared"""),
    "agreement_counts": (
        lambda ws: AN.category_counts(
            AN.two_way_agreement(ws.stored.predictions, ws.stored.alerts), "agreement_category", S.AGREEMENT),
        """SELECT 'MODEL_AND_NP3' AS agreement_category, count(*) FILTER (pred = 1 AND rule = 1) AS rows FROM compared
            UNION ALL SELECT 'MODEL_ONLY', count(*) FILTER (pred = 1 AND rule = 0) FROM compared
            UNION ALL SELECT 'NP3_ONLY', count(*) FILTER (pred = 0 AND rule = 1) FROM compared
            UNION ALL SELECT 'NEITHER', count(*) FILTER (pred = 0 AND rule = 0) FROM compared"""),
    "three_way_comparison": (
        lambda ws: _cast(AN.three_way_comparison(ws.stored.predictions, ws.stored.scores, ws.stored.alerts).select(
            "grid_id", "prediction_timestamp", "prediction_probability", "anomaly_score",
            "anomaly_direction", X, "ML4_ANOMALY", "NP3_ALERT", "ML3_PREDICTION", "comparison_category"),
            ML4_ANOMALY="bigint", NP3_ALERT="bigint", ML3_PREDICTION="bigint"),
        f"""SELECT grid_id, {T('prediction_timestamp')} AS prediction_timestamp, {R('p')} AS prediction_probability,
            {R('anomaly_score')} AS anomaly_score, anomaly_direction, {R(X)} AS total_activity,
            CAST(odd AS BIGINT) AS ML4_ANOMALY, CAST(rule AS BIGINT) AS NP3_ALERT, CAST(pred AS BIGINT) AS ML3_PREDICTION,
            comparison_category FROM categories"""),
    "comparison_counts": (
        lambda ws: AN.category_counts(
            AN.three_way_comparison(ws.stored.predictions, ws.stored.scores, ws.stored.alerts),
            "comparison_category", S.COMPARISON),
        f"""SELECT name AS comparison_category, count(c.grid_id) AS rows FROM {_values(S.COMPARISON)}
            LEFT JOIN categories c ON c.comparison_category = v.name GROUP BY 1"""),
    "representative_disagreement": (
        lambda ws: AN.representative_disagreement(
            AN.three_way_comparison(ws.stored.predictions, ws.stored.scores, ws.stored.alerts)
        ).select("grid_id", "prediction_timestamp", "anomaly_score", "comparison_category"),
        f"""SELECT grid_id, {T('prediction_timestamp')} AS prediction_timestamp, {R('anomaly_score')} AS anomaly_score,
            comparison_category FROM categories c JOIN {_values(S.DISAGREEMENT_ORDER)} ON v.name = c.comparison_category
            ORDER BY v.i, c.grid_id, c.prediction_timestamp LIMIT 1"""),
    # --- warehouse
    "warehouse_source": (
        lambda ws: _cast(ws.source, hour="bigint"),
        f"""SELECT grid_id, {T('event_time')} AS event_time, {rounded('sms_count', 'call_count', 'internet_volume')},
            {D('date')} AS date, hour, day_of_week FROM fact"""),
    "dim_time": (
        lambda ws: _cast(ws.dim_time, hour="bigint"),
        f"SELECT time_key, {D('event_date')} AS event_date, hour, day_of_week FROM dim_time"),
    "dim_grid": (
        lambda ws: ws.stored.dim_grid,
        f"""SELECT grid_key, grid_id, {rounded('centroid_latitude', 'centroid_longitude')}, geometry_reference
            FROM dim_grid"""),
    "fact_activity": (
        lambda ws: WH.fact_keys(ws.stored.keyed_fact),
        f"""SELECT row_number() OVER (ORDER BY f.event_time, f.grid_id) AS fact_key, t.time_key, g.grid_key, f.grid_id,
            {T('f.event_time')} AS event_time, {rounded('sms_count', 'call_count', 'internet_volume', prefix='f.')}
            FROM fact f JOIN dim_time t ON t.event_date = f.date AND t.hour = f.hour
            JOIN dim_grid g ON g.grid_id = f.grid_id"""),
    "wh_top_grids": (
        lambda ws: WH.top_grids(ws.stored.keyed_fact, ws.stored.dim_grid),
        f"""SELECT grid_id, {rounded('total_sms', 'total_calls', 'total_internet')} FROM (SELECT grid_id,
            sum(sms_count) AS total_sms, sum(call_count) AS total_calls, sum(internet_volume) AS total_internet
            FROM fact GROUP BY 1) s ORDER BY s.total_sms + s.total_calls + s.total_internet DESC, grid_id LIMIT 10"""),
    "wh_hourly_trend": (
        lambda ws: _cast(WH.hourly_trend(ws.stored.keyed_fact, ws.stored.dim_time), hour="bigint"),
        f"""SELECT {D('date')} AS event_date, hour, {rounded('total_sms', 'total_calls', 'total_internet')} FROM (
            SELECT date, hour, sum(sms_count) AS total_sms, sum(call_count) AS total_calls,
            sum(internet_volume) AS total_internet FROM fact GROUP BY 1, 2) s"""),
    "wh_internet_hours": (
        lambda ws: _cast(WH.internet_heavy_hours(ws.stored.keyed_fact, ws.stored.dim_time), hour="bigint"),
        f"""SELECT {D('date')} AS event_date, hour, {R('i')} AS total_internet FROM (SELECT date, hour,
            sum(internet_volume) AS i FROM fact GROUP BY 1, 2) s ORDER BY i DESC, date, hour LIMIT 10"""),
    "wh_top5_internet": (
        lambda ws: WH.top_internet_grids(ws.stored.keyed_fact, ws.stored.dim_grid),
        f"""SELECT grid_id, {R('i')} AS internet_volume FROM (SELECT grid_id, sum(internet_volume) AS i FROM fact
            GROUP BY 1) s ORDER BY i DESC, grid_id LIMIT 5"""),
    "wh_checks": (
        lambda ws: WH.warehouse_checks(ws.stored.source, ws.stored.dim_grid, ws.stored.keyed_fact),
        None),
    # --- learning
    "temporal_features": (
        lambda ws: series.temporal_features(ws.hourly),
        f"""SELECT grid_id, {T('feature_timestamp')} AS feature_timestamp, {rounded(*S.TEMPORAL_FEATURES)}
            FROM temporal"""),
    "next_hour_label": (
        lambda ws: _cast(ws.labelled.select(
            "grid_id", "feature_timestamp", "prediction_timestamp", "future_total_activity",
            "baseline_activity", "high_activity_threshold", "HIGH_ACTIVITY"), HIGH_ACTIVITY="bigint"),
        f"""SELECT grid_id, {T('feature_timestamp')} AS feature_timestamp, {T('prediction_timestamp')} AS prediction_timestamp,
            {rounded('future_total_activity', 'baseline_activity', 'high_activity_threshold')},
            CAST(high AS BIGINT) AS HIGH_ACTIVITY FROM labelled"""),
    "next_hour_label_joined": (
        lambda ws: _cast(series.next_hour_label(ws.features, ws.hourly).select(
            "grid_id", "feature_timestamp", "future_total_activity", "HIGH_ACTIVITY"),
            HIGH_ACTIVITY="bigint"),
        f"""SELECT grid_id, {T('feature_timestamp')} AS feature_timestamp,
            {R('future_total_activity')} AS future_total_activity, CAST(high AS BIGINT) AS HIGH_ACTIVITY FROM labelled"""),
    "chrono_split_counts": (
        lambda ws: ws.labelled.withColumn("train_end", ws.train_end).groupBy("train_end").agg(
            F.count_if(F.col("prediction_timestamp") <= F.col("train_end")).alias("train_rows"),
            F.count_if(F.col("prediction_timestamp") > F.col("train_end")).alias("test_rows")),
        f"""SELECT {T('e.train_end')} AS train_end, count(*) FILTER (prediction_timestamp <= e.train_end) AS train_rows,
            count(*) FILTER (prediction_timestamp > e.train_end) AS test_rows
            FROM labelled CROSS JOIN train_end e GROUP BY e.train_end"""),
    "class_balance": (
        lambda ws: L.class_balance(ws.labelled),
        f"""SELECT z AS count_0, o AS count_1, n AS rows, {R('z * 100.0::DOUBLE / n')} AS percent_0,
            {R('o * 100.0::DOUBLE / n')} AS percent_1 FROM (SELECT count(*) FILTER (high = 0) AS z,
            count(*) FILTER (high = 1) AS o, count(*) AS n FROM labelled) s"""),
    "threshold_sweep": (
        lambda ws: L.threshold_sweep(ws.scored),
        f"""SELECT {R('t')} AS threshold, tp, fp, {R(ratio('tp + neg - fp', 'pos + neg'))} AS accuracy,
            {R(ratio('tp', 'tp + fp'))} AS precision, {R(ratio('tp', 'pos'))} AS recall,
            {R(ratio('2 * tp', 'pos + tp + fp'))} AS f1,
            {R(f"({ratio('tp', 'pos')} + {ratio('neg - fp', 'neg')}) / 2")} AS balanced_accuracy
            FROM (SELECT t, count(*) FILTER (p >= t AND high = 1) AS tp, count(*) FILTER (p >= t AND high = 0) AS fp,
                  count(*) FILTER (high = 1) AS pos, count(*) FILTER (high = 0) AS neg
                  FROM labelled, (SELECT 0.1::DOUBLE + k * 0.01::DOUBLE AS t FROM range(81) r(k)) ts GROUP BY t) s"""),
    "best_threshold": (
        lambda ws: L.best_threshold(L.threshold_sweep(ws.scored)).select(
            "threshold", "tp", "fp", "f1", "meets_limits"),
        f"""SELECT {R('t')} AS threshold, tp, fp, {R('f1')} AS f1, fits AS meets_limits FROM (
            SELECT *, pr >= 0.6::DOUBLE AND acc >= 0.9::DOUBLE AS fits FROM (
            SELECT t, tp, fp, {ratio('2 * tp', 'pos + tp + fp')} AS f1, {ratio('tp', 'tp + fp')} AS pr,
              {ratio('tp', 'pos')} AS rc, {ratio('tp + neg - fp', 'pos + neg')} AS acc
            FROM (SELECT t, count(*) FILTER (p >= t AND high = 1) AS tp, count(*) FILTER (p >= t AND high = 0) AS fp,
                  count(*) FILTER (high = 1) AS pos, count(*) FILTER (high = 0) AS neg
                  FROM labelled, (SELECT 0.1::DOUBLE + k * 0.01::DOUBLE AS t FROM range(81) r(k)) ts GROUP BY t) s) m) x
            ORDER BY fits DESC, CASE WHEN fits THEN rc ELSE f1 END DESC, CASE WHEN fits THEN f1 ELSE rc END DESC,
              pr DESC, acc DESC, t LIMIT 1"""),
    "auc": (
        lambda ws: L.auc(ws.scored),
        f"""SELECT pos AS positives, neg AS negatives, {R(ratio('rs - pos * (pos + 1) / 2.0::DOUBLE', 'pos * neg'))} AS auc
            FROM (SELECT sum(avg_rank) FILTER (high = 1) AS rs, count(*) FILTER (high = 1) AS pos,
                  count(*) FILTER (high = 0) AS neg FROM (
              SELECT high, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS avg_rank
              FROM labelled) r) s"""),
    "prediction_bias": (
        lambda ws: L.prediction_bias(ws.predictions),
        f"""SELECT {R('a')} AS actual_rate, {R('b')} AS predicted_rate, {R(f"{ratio('b - a', 'a')} * 100")} AS bias_percent
            FROM (SELECT avg(high) AS a, avg(pred) AS b FROM labelled) s"""),
    "risk_levels": (
        lambda ws: L.risk_summary(ws.risk),
        """SELECT count(*) AS rows, count(*) FILTER (risk_level = 'HIGH') AS high_rows,
            count(*) FILTER (risk_level = 'ATTENTION') AS attention_rows,
            count(*) FILTER (risk_level = 'LOW') AS low_rows, CAST(0 AS BIGINT) AS duplicate_keys FROM risk"""),
    "risk_table": (
        lambda ws: ws.risk,
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R('risk_score')} AS risk_score, risk_level, model_version
            FROM risk"""),
    "leakage_checks": (
        lambda ws: Q.leakage_checks(ws.stored.labelled, ws.stored.hourly, ws.stored.train_end),
        None),
    "feature_integrity": (
        lambda ws: Q.feature_integrity(ws.stored.features),
        None),
    "feature_key_match": (
        lambda ws: Q.key_match(series.feature_windows(ws.hourly), series.temporal_features(ws.hourly)),
        """SELECT CAST(0 AS BIGINT) AS left_duplicates, CAST(0 AS BIGINT) AS right_duplicates, f AS matched_keys,
            CAST(0 AS BIGINT) AS left_only, n - f AS right_only
            FROM (SELECT (SELECT count(*) FROM wfeat) AS f, (SELECT count(*) FROM hourly) AS n) s"""),
    "request_errors": (
        lambda ws: Q.request_errors(_requests(ws)).select(
            "grid_id", "feature_timestamp", F.array_join("errors", ",").alias("errors")),
        f"""SELECT grid_id, {T('feature_timestamp')} AS feature_timestamp, concat_ws(',',
            CASE WHEN avg_activity < 0 THEN 'avg_activity_negative' END,
            CASE WHEN active_hours < 0 THEN 'active_hours_negative' END,
            CASE WHEN internet_share < 0 THEN 'internet_share_negative' END,
            CASE WHEN active_hours > 24 THEN 'active_hours_above_24' END,
            CASE WHEN internet_share > 1 THEN 'internet_share_above_1' END,
            CASE WHEN activity_growth IS NULL THEN 'activity_growth_missing' END) AS errors
            FROM (SELECT grid_id, feature_timestamp, CASE WHEN activity_growth > 1 THEN -avg_activity ELSE avg_activity END AS avg_activity,
              CASE WHEN activity_growth < -0.5 THEN NULL ELSE activity_growth END AS activity_growth,
              active_hours + CASE WHEN peak_ratio > 8 THEN 1 ELSE 0 END AS active_hours, internet_share * 2 - 0.1 AS internet_share
              FROM wfeat) r"""),
    # --- files
    "file_gate_rows": (
        lambda ws: gates.row_gate(FX.file_rows(ws.raw)),
        None),
    "file_gate_status": (
        lambda ws: _routed(ws), None),
    "ingest_manifest_diff": (
        lambda ws: gates.new_files(FX.file_rows(ws.raw).select("filename").distinct(),
                                   FX.accepted_files(ws.raw)),
        f"""SELECT DISTINCT 'sms-call-internet-mi-' || {D('timestamp')} || '.csv' AS filename FROM raw
            WHERE CAST(timestamp AS DATE) NOT IN (SELECT CAST(timestamp AS DATE) FROM raw WHERE sms_out > 250)"""),
    "upsert_scores": (
        lambda ws: merge_scores(ws.risk, _rescored(ws)),
        f"""SELECT r.grid_id, {T('r.timestamp')} AS timestamp,
            CASE WHEN l.grid_id IS NULL THEN {R('r.risk_score')} ELSE {R('1 - r.risk_score')} END AS risk_score,
            CASE WHEN l.grid_id IS NULL THEN r.risk_level WHEN round(1 - r.risk_score, 6) >= 0.8 THEN 'HIGH'
              WHEN round(1 - r.risk_score, 6) >= 0.5 THEN 'ATTENTION' ELSE 'LOW' END AS risk_level,
            CASE WHEN l.grid_id IS NULL THEN r.model_version ELSE 'logistic-v2' END AS model_version
            FROM risk r LEFT JOIN labelled l ON l.grid_id = r.grid_id AND l.feature_timestamp = r.timestamp"""),
    # --- text
    "grounding_sections": (
        lambda ws: FX.responses(ws.spark, ws.folder).select(
            "conv_id", "turn", grounding.has_sections(F.col("response")).alias("sections_ok")),
        """SELECT conv_id, turn, contains(response, 'SEVERITY') AND contains(response, 'EVIDENCE')
            AND contains(response, 'INTERPRETATION') AND contains(response, 'NEXT CHECKS') AS sections_ok FROM answers"""),
    "grounding_numbers": (
        lambda ws: FX.responses(ws.spark, ws.folder).select("conv_id", "turn", F.array_join(
            grounding.unsupported_numbers(F.col("response"), F.col("evidence")), " "
        ).alias("unsupported")),
        r"""SELECT a.conv_id, a.turn, coalesce(u.unsupported, '') AS unsupported FROM answers a LEFT JOIN (
            SELECT conv_id, turn, string_agg(DISTINCT token, ' ' ORDER BY token) AS unsupported FROM (
              SELECT conv_id, turn, evidence, token, CAST(rtrim(token, '%') AS DOUBLE) AS v FROM (
                SELECT conv_id, turn, evidence, unnest(regexp_extract_all(replace(split_part(
                  substr(response, position('EVIDENCE' IN response) + 8), 'INTERPRETATION', 1), '%', '% '),
                  '(^|[^A-Za-z0-9])([-+]?\d+(?:\.\d+)?%?)', 2)) AS token FROM answers) t) n
            WHERE NOT (v = floor(v) AND v BETWEEN 1 AND 20 AND NOT contains(token, '.') AND NOT contains(token, '%'))
              AND len(list_filter(evidence, lambda g: g IS NOT NULL AND (
                abs(v - g) <= greatest(0.01::DOUBLE, abs(g) * 0.02::DOUBLE)
                OR (contains(token, '%') AND abs(v - g * 100) <= greatest(0.1::DOUBLE, abs(g * 100) * 0.02::DOUBLE))))) = 0
            GROUP BY 1, 2) u ON u.conv_id = a.conv_id AND u.turn = a.turn"""),
    "grounding_phrases": (
        lambda ws: FX.responses(ws.spark, ws.folder).select(
            "conv_id", "turn", (~grounding.asserts_congestion(F.col("response"))).alias("no_congestion_claim")),
        "SELECT conv_id, turn, NOT (" + " OR ".join(
            f"contains(lower(response), '{p}')" for p in grounding.FORBIDDEN)
        + ") AS no_congestion_claim FROM answers"),
    "grounding_insufficient": (
        lambda ws: grounding.grounding_report(FX.responses(ws.spark, ws.folder)).select(
            "conv_id", "turn", "insufficiency_detected", "insufficiency_ok"),
        """SELECT conv_id, turn, contains(lower(response), 'insufficient evidence') AS insufficiency_detected,
            contains(lower(response), 'insufficient evidence') OR anomaly_score IS NOT NULL AS insufficiency_ok
            FROM answers"""),
}


def _requests(ws):
    """Scoring requests made of the feature rows, some pushed over their bounds."""
    growth = F.col("activity_growth")
    return series.feature_windows(ws.hourly).withColumns({
        "avg_activity": F.when(growth > 1, -F.col("avg_activity")).otherwise(F.col("avg_activity")),
        "activity_growth": F.when(growth < -0.5, None).otherwise(growth),
        "active_hours": F.col("active_hours") + F.when(F.col("peak_ratio") > 8, 1).otherwise(0),
        "internet_share": F.col("internet_share") * 2 - 0.1,
    })


def _rescored(ws):
    """A second scoring, of the rows that have a label, under another version."""
    other = ws.scored.withColumn(
        "prediction_probability", F.round(1 - F.col("prediction_probability"), 6)
    )
    return L.risk_rows(other, "logistic-v2")


def _routed(ws):
    rows = FX.file_rows(ws.raw)
    files = rows.select("filename").distinct()
    # Days that end in 5 come without a column, those that end in 9 without a header.
    full, day = F.array(*[F.lit(c) for c in S.RAW_COLUMNS]), F.substring("filename", -5, 1)
    short = F.array(*[F.lit(c) for c in S.RAW_COLUMNS if c != "callin"])
    headers = files.withColumn("header", F.when(day == "5", short).when(day != "9", full))
    checked = gates.header_gate(files, headers)
    return gates.route_files(checked, gates.row_gate(rows), FX.accepted_files(ws.raw))


_VALUE = "coalesce(" + ", ".join(MEASURES) + ")"
_CODES = f"""CASE WHEN v > 330 THEN 'MALFORMED_TIMESTAMP' WHEN v BETWEEN 320 AND 330 THEN 'INVALID_CELLID'
    WHEN v BETWEEN 310 AND 320 THEN 'CELLID_OUT_OF_RANGE' WHEN v BETWEEN 300 AND 310 THEN 'NON_NUMERIC_' || kind
    WHEN v BETWEEN 290 AND 300 THEN 'NEGATIVE_' || kind END"""
_KIND = "CASE event_type WHEN 'click' THEN 'smsin' WHEN 'signup' THEN 'smsout' WHEN 'purchase' THEN 'callin' WHEN 'error' THEN 'callout' ELSE 'internet' END"
_GATED = f"""SELECT filename, coalesce(min(seen) FILTER (code IS NOT NULL), max(seen)) AS row_count,
    coalesce(min_by(code, seen) FILTER (code IS NOT NULL) || '_AT_ROW_' || (min(seen) FILTER (code IS NOT NULL) + 1),
      'QUALITY_VALID') AS quality_reason
    FROM (SELECT filename, {_CODES} AS code, row_number() OVER (PARTITION BY filename ORDER BY event_id) AS seen
      FROM (SELECT event_id, 'sms-call-internet-mi-' || {D('ts')} || '.csv' AS filename, value AS v, {_KIND} AS kind
            FROM events) e) c GROUP BY 1"""
_TAKEN = f"SELECT 'sms-call-internet-mi-' || {D('timestamp')} || '.csv' FROM raw WHERE sms_out > 250"
QUERIES["file_gate_rows"] = (QUERIES["file_gate_rows"][0], _GATED)
_SCHEMA = "CASE substr(filename, -5, 1) WHEN '5' THEN 'MISSING_COLUMNS:callin' WHEN '9' THEN 'EMPTY_FILE' ELSE 'SCHEMA_VALID' END"
QUERIES["file_gate_status"] = (QUERIES["file_gate_status"][0], f"""SELECT filename,
    CASE WHEN reason <> 'QUALITY_VALID' THEN 'REJECTED' WHEN taken THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status,
    CASE WHEN {_SCHEMA} = 'SCHEMA_VALID' THEN row_count ELSE 0 END AS row_count,
    CASE WHEN reason = 'QUALITY_VALID' AND taken THEN 'FILE_ALREADY_EXISTS_IN_RAW' ELSE reason END AS reason
    FROM (SELECT *, filename IN ({_TAKEN}) AS taken,
            CASE WHEN {_SCHEMA} = 'SCHEMA_VALID' THEN quality_reason ELSE {_SCHEMA} END AS reason FROM ({_GATED}) g) z""")


def _warehouse_sql(keep: str, grids: str) -> str:
    """The warehouse checks over facts that meet `keep` and a grid dimension given as a table."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("sms_count", "call_count", "internet_volume"))
    close = " AND ".join(f"abs(s.{c} - f.{c}) <= 1e-9 * greatest(abs(s.{c}), 1)" for c in ("sms_count", "call_count", "internet_volume"))
    return f"""SELECT u.* FROM (SELECT count(*) AS n, count(DISTINCT grid_id) AS g, {sums} FROM fact) s
        CROSS JOIN (SELECT count(*) AS n, {sums} FROM fact f JOIN dim_time t ON t.event_date = f.date AND t.hour = f.hour
          WHERE grid_id IN (SELECT grid_id FROM dim_grid) AND {keep}) f
        CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (c > 1) AS twice, sum(c) AS rows FROM
          (SELECT grid_id, count(*) AS c FROM {grids} GROUP BY 1) k) d,
        LATERAL (SELECT 'fact_rows_equal_source' AS name, s.n = f.n AS passed, 'source=' || s.n || ', fact=' || f.n AS details
          UNION ALL SELECT 'dim_grid_equals_distinct_grids', s.g = d.rows, 'source_distinct=' || s.g || ', dim_grid=' || d.rows
          UNION ALL SELECT 'no_duplicate_dim_grid', d.twice = 0, 'duplicates=' || d.twice
          UNION ALL SELECT 'fact_has_no_geometry', NOT list_contains({WH.FACT_COLUMNS}, 'geometry'), 'geometry column absent'
          UNION ALL SELECT 'sums_match_source', {close}, 'tolerance=1e-09') u"""


def _leakage_sql(rows: str) -> str:
    """The leakage checks over labelled rows given as a table."""
    return f"""SELECT q.* FROM (WITH rows_ AS (SELECT l.*, h.total_activity AS actual, l.prediction_timestamp <= (SELECT train_end FROM train_end) AS early
          FROM {rows} l LEFT JOIN hourly h ON h.grid_id = l.grid_id AND h.timestamp = l.prediction_timestamp),
        counts AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM rows_ GROUP BY grid_id, feature_timestamp HAVING count(*) > 1) d) AS a,
          count(*) FILTER (prediction_timestamp <= feature_timestamp) AS b,
          count(*) FILTER (prediction_timestamp <> feature_timestamp + INTERVAL 1 HOUR) AS c,
          count(*) FILTER (coalesce(actual <> future_total_activity, true)) AS d,
          count(*) FILTER (high <> CAST(future_total_activity > high_activity_threshold AS INTEGER)) AS e,
          CAST(coalesce(max(prediction_timestamp) FILTER (early) >= min(prediction_timestamp) FILTER (NOT early), true) AS BIGINT) AS f,
          CAST(count(*) = 0 AS BIGINT) AS g FROM rows_)
        SELECT u.name AS check, u.n AS failures, u.n = 0 AS passed FROM counts,
          LATERAL (SELECT 'duplicate_features' AS name, a AS n UNION ALL SELECT 'feature_not_before_target', b
            UNION ALL SELECT 'target_not_next_hour', c UNION ALL SELECT 'target_misaligned', d UNION ALL SELECT 'label_disagrees', e
            UNION ALL SELECT 'train_test_overlap', f UNION ALL SELECT 'no_rows', g) u) q"""


def _integrity_sql(rows: str) -> str:
    bad = {n: f"count(*) FILTER ({n} IS NULL OR NOT isfinite(CAST({n} AS DOUBLE)))" for n in S.MODEL_FEATURES}
    twice = f"(SELECT count(*) FROM (SELECT 1 FROM {rows} x GROUP BY grid_id, feature_timestamp HAVING count(*) > 1) d)"
    return (f"SELECT count(*) AS rows, {twice} AS duplicate_keys, " + ", ".join(f"{e} AS bad_{n}" for n, e in bad.items())
            + f", {twice} = 0 AND {' + '.join(bad.values())} = 0 AS passed FROM {rows} r")


def _faulted_labels(labelled):
    """Labelled rows with a late target, a turned label, and the rows of a grid twice."""
    hour = F.hour("feature_timestamp")
    return labelled.union(labelled.filter("grid_id = '7'")).withColumns({
        "prediction_timestamp": F.when(hour == 3, F.col("prediction_timestamp") + F.expr("INTERVAL 1 HOUR"))
        .when(hour == 4, F.col("feature_timestamp")).otherwise(F.col("prediction_timestamp")),
        "HIGH_ACTIVITY": F.when(hour == 5, 1 - F.col("HIGH_ACTIVITY")).otherwise(F.col("HIGH_ACTIVITY")),
    })


_LATE = """(SELECT * REPLACE (CASE hour(feature_timestamp) WHEN 3 THEN prediction_timestamp + INTERVAL 1 HOUR
    WHEN 4 THEN feature_timestamp ELSE prediction_timestamp END AS prediction_timestamp,
    CASE hour(feature_timestamp) WHEN 5 THEN 1 - high ELSE high END AS high)
    FROM (SELECT * FROM labelled UNION ALL SELECT * FROM labelled WHERE grid_id = '7') w)"""
_GAPS = """(SELECT * REPLACE (CASE WHEN hour(feature_timestamp) <> 5 THEN activity_growth END AS activity_growth)
    FROM (SELECT * FROM features UNION ALL SELECT * FROM features WHERE grid_id = '7') w)"""


def _faulted_features(features):
    return features.union(features.filter("grid_id = '7'")).withColumn(
        "activity_growth", F.when(F.hour("feature_timestamp") != 5, F.col("activity_growth")))


def _faulted_warehouse(ws):
    """One hour of facts lost, and a grid twice in the dimension."""
    fact = ws.keyed_fact.filter(F.hour("event_time") != 6)
    return WH.warehouse_checks(ws.source, ws.dim_grid.union(ws.dim_grid.filter("grid_id = '7'")), fact)


QUERIES["wh_checks"] = (QUERIES["wh_checks"][0], _warehouse_sql("true", "dim_grid"))
QUERIES["leakage_checks"] = (QUERIES["leakage_checks"][0], _leakage_sql("labelled"))
QUERIES["feature_integrity"] = (QUERIES["feature_integrity"][0], _integrity_sql("features"))
QUERIES |= {
    "wh_checks_faulted": (lambda ws: _faulted_warehouse(ws.stored), _warehouse_sql(
        "hour(event_time) <> 6", "(SELECT * FROM dim_grid UNION ALL SELECT * FROM dim_grid WHERE grid_id = '7')")),
    "leakage_checks_faulted": (
        lambda ws: Q.leakage_checks(_faulted_labels(ws.stored.labelled), ws.stored.hourly, ws.stored.train_end), _leakage_sql(_LATE)),
    "feature_integrity_faulted": (
        lambda ws: Q.feature_integrity(_faulted_features(ws.stored.features)), _integrity_sql(_GAPS)),
}
