"""Common table expressions of the comparison SQL, and its assembly."""

import re

MEASURES = ["sms_in", "sms_out", "call_in", "call_out", "internet_activity"]
KINDS = ["click", "signup", "purchase", "error", "view"]
SUM4 = ", ".join(f"sum({c}) AS {c}" for c in
                 ("total_sms", "total_calls", "internet_activity", "total_activity"))


def T(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def D(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def R(x: str) -> str:
    """Rounded like the registered results, without a negative zero."""
    return (f"(CASE WHEN abs({x}) < 0.0000005 THEN 0.0::DOUBLE "
            f"ELSE round(({x})::DOUBLE + 0.000000001::DOUBLE, 6) END)")


def rounded(*names: str, prefix="") -> str:
    return ", ".join(f"{R(prefix + n)} AS {n}" for n in names)


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 OR ({b}) IS NULL THEN 0.0::DOUBLE ELSE coalesce(({a})::DOUBLE / ({b}), 0.0) END)"


def loo(bucket: str) -> str:
    """Leave-one-out median by a join of each row with the others of its bucket."""
    return f"""
  SELECT r.grid_id, r.timestamp,
    CASE WHEN r.n = 0 THEN NULL ELSE (r.l[(r.n + 1) // 2] + r.l[r.n // 2 + 1]) / 2 END AS baseline_activity
  FROM (SELECT a.grid_id, a.timestamp, count(b.total_activity) AS n,
               list_sort(list(b.total_activity)) AS l
        FROM hourly a LEFT JOIN hourly b
          ON a.grid_id = b.grid_id AND a.{bucket} = b.{bucket} AND a.timestamp <> b.timestamp
        GROUP BY a.grid_id, a.timestamp) r"""


def square(key: str) -> str:
    x = f"(9.0::DOUBLE + (({key}) % 100) * 0.003::DOUBLE)"
    y = f"(45.0::DOUBLE + (({key}) // 100) * 0.003::DOUBLE)"
    return f"{x} AS x0, {y} AS y0, {x} + 0.003::DOUBLE AS x1, {y} + 0.003::DOUBLE AS y1"


_values = ", ".join(
    f"CASE WHEN event_type = '{k}' THEN value END AS {m}" for m, k in zip(MEASURES, KINDS))
_negated = ", ".join(
    f"CASE WHEN event_id % 97 = 0 THEN -{m} ELSE {m} END AS {m}" for m in MEASURES)
_broken = f"""SELECT event_id, CASE WHEN event_id % 103 <> 0 THEN timestamp END AS timestamp,
    CASE WHEN event_id % 101 <> 0 THEN grid_id END AS grid_id, country_code, {_negated} FROM raw"""
_negative = " OR ".join(f"coalesce({m} < 0, false)" for m in MEASURES)
_series = "PARTITION BY grid_id ORDER BY timestamp"
_recent = f"OVER ({_series} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_past = f"OVER ({_series} ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)"


def full_mean(n: int) -> str:
    w = f"OVER ({_series} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {w} = {n} THEN avg(total_activity) {w} END"


def trailing_mean(time="timestamp") -> str:
    return (f"avg(total_activity) OVER (PARTITION BY grid_id ORDER BY {time} RANGE BETWEEN "
            "INTERVAL 604799 SECONDS PRECEDING AND INTERVAL 1 SECOND PRECEDING)")


CTES = {
    "raw": f"""SELECT event_id, ts AS timestamp, CAST(user_id + 1 AS VARCHAR) AS grid_id,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS VARCHAR) AS country_code,
    {_values} FROM events""",
    "bad": f"""SELECT b.*, CASE WHEN timestamp IS NULL THEN 'MISSING_TIMESTAMP'
      WHEN grid_id IS NULL THEN 'MISSING_GRID' WHEN {_negative} THEN 'NEGATIVE_MEASURE' END AS reject_reason
    FROM ({_broken} UNION ALL SELECT * FROM ({_broken}) d WHERE event_id % 107 = 0) b""",
    "h0": "SELECT grid_id, date_trunc('hour', timestamp) AS ts, "
          + ", ".join(f"round(sum(coalesce({m}, 0)), 4) AS {m}" for m in MEASURES)
          + " FROM raw GROUP BY 1, 2",
    "hourly": """SELECT grid_id, ts AS timestamp, sms_in, sms_out, call_in, call_out, internet_activity,
    round(sms_in + sms_out, 4) AS total_sms, round(call_in + call_out, 4) AS total_calls,
    round((sms_in + sms_out) + (call_in + call_out) + internet_activity, 4) AS total_activity,
    CAST(ts AS DATE) AS date, hour(ts) AS hour_of_day FROM h0""",
    "fact": """SELECT grid_id, timestamp AS event_time, total_sms AS sms_count, total_calls AS call_count,
    internet_activity AS internet_volume, total_sms + total_calls + internet_activity AS total,
    date, hour_of_day AS hour, dayname(timestamp) AS day_of_week FROM hourly""",
    "latest": "SELECT max(event_time) AS as_of FROM fact",
    "roll": f"""SELECT *, CASE WHEN count(*) {_recent} = 24 THEN list_sort(list(total_activity) {_recent}) END AS l
    FROM hourly""",
    "median24": "SELECT *, (l[12] + l[13]) / 2 AS baseline_activity FROM roll",
    "loo_day": loo("date"),
    "loo_hour": loo("hour_of_day"),
    "days": "SELECT grid_id, date, round(sum(total_activity), 6) AS day_total FROM hourly GROUP BY 1, 2",
    "floor": "SELECT quantile_cont(day_total, 0.1) AS activity_floor FROM days",
    "rules": """SELECT h.grid_id, h.timestamp, h.total_activity AS cur, p.prev, l.baseline_activity AS base
    FROM hourly h
    JOIN (SELECT grid_id, timestamp, lag(total_activity) OVER (PARTITION BY grid_id ORDER BY timestamp) AS prev
          FROM hourly) p ON p.grid_id = h.grid_id AND p.timestamp = h.timestamp
    JOIN loo_day l ON l.grid_id = h.grid_id AND l.timestamp = h.timestamp
    JOIN days d ON d.grid_id = h.grid_id AND d.date = h.date
    WHERE l.baseline_activity IS NOT NULL AND d.day_total >= (SELECT activity_floor FROM floor)""",
    "alerts": """SELECT grid_id, timestamp, 'HIGH_ACTIVITY' AS alert_type, 1 AS rule, 'HIGH' AS severity, cur, base
      FROM rules WHERE cur >= base * 1.5::DOUBLE
    UNION ALL SELECT grid_id, timestamp, 'ACTIVITY_SPIKE', 2, 'MEDIUM', cur, base FROM rules
      WHERE prev > 0 AND cur >= prev * 1.5::DOUBLE
    UNION ALL SELECT grid_id, timestamp, 'ACTIVITY_DROP', 3, 'LOW', cur, base FROM rules
      WHERE cur <= base * 0.7::DOUBLE""",
    "alert_keys": "SELECT DISTINCT grid_id, timestamp FROM alerts",
    "last_alert": """SELECT * FROM (SELECT *, row_number() OVER
      (PARTITION BY grid_id ORDER BY timestamp DESC, rule) AS rn FROM alerts) q WHERE rn = 1""",
    "anomalies": """SELECT a.*, CASE WHEN anomaly_score >= 0.5 THEN 'HIGH' WHEN anomaly_score <= -0.5 THEN 'LOW'
      ELSE 'NORMAL' END AS anomaly_direction,
      CASE WHEN anomaly_score >= 0.5 OR anomaly_score <= -0.5 THEN 1 ELSE 0 END AS anomaly_flag
    FROM (SELECT h.grid_id, h.timestamp, h.total_activity, h.hour_of_day, l.baseline_activity,
            CASE WHEN l.baseline_activity > 0
              THEN (h.total_activity - l.baseline_activity) / l.baseline_activity END AS anomaly_score
          FROM hourly h JOIN loo_hour l ON l.grid_id = h.grid_id AND l.timestamp = h.timestamp) a""",
    "windows": f"""SELECT grid_id, timestamp, row_number() OVER ({_series}) AS rn,
      avg(total_activity) {_recent} AS m, avg(total_activity) {_past} AS pm,
      max(total_activity) {_recent} AS mx, stddev_pop(total_activity) {_recent} AS sd,
      count(*) FILTER (total_activity > 0) {_recent} AS act,
      sum(internet_activity) {_recent} AS si, sum(total_activity) {_recent} AS st FROM hourly""",
    "wfeat": f"""SELECT grid_id, timestamp AS feature_timestamp, m AS avg_activity,
      {ratio('m - pm', 'pm')} AS activity_growth, CAST(act AS INTEGER) AS active_hours,
      {ratio('mx', 'm')} AS peak_ratio, sd AS variability,
      greatest(0.0, least(1.0, {ratio('si', 'st')})) AS internet_share FROM windows WHERE rn >= 48""",
    "temporal": f"""SELECT *, current_activity - previous_hour_activity AS activity_change,
      CASE WHEN previous_hour_activity > 0 THEN (current_activity - previous_hour_activity) / previous_hour_activity
        ELSE 0.0 END AS activity_change_pct
    FROM (SELECT grid_id, timestamp AS feature_timestamp, total_activity AS current_activity,
      lag(total_activity) OVER ({_series}) AS previous_hour_activity,
      {full_mean(3)} AS rolling_3h_activity, {full_mean(6)} AS rolling_6h_activity,
      {full_mean(24)} AS rolling_24h_activity FROM hourly) t""",
    "features": """SELECT w.*, t.* EXCLUDE (grid_id, feature_timestamp) FROM wfeat w
      JOIN temporal t ON t.grid_id = w.grid_id AND t.feature_timestamp = w.feature_timestamp""",
    "prob": """SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE +
      exp(-((peak_ratio - 4.0::DOUBLE) * 0.8::DOUBLE + activity_growth))), 6) AS p FROM features""",
    "risk": """SELECT grid_id, feature_timestamp AS timestamp, p AS risk_score,
      CASE WHEN p >= 0.8 THEN 'HIGH' WHEN p >= 0.5 THEN 'ATTENTION' ELSE 'LOW' END AS risk_level,
      'logistic-v1' AS model_version FROM prob""",
    "labelled": """SELECT f.*, n.total_activity AS future_total_activity, b.baseline_activity,
      b.baseline_activity * 1.5::DOUBLE AS high_activity_threshold,
      CASE WHEN n.total_activity > b.baseline_activity * 1.5::DOUBLE THEN 1 ELSE 0 END AS high,
      f.feature_timestamp + INTERVAL 1 HOUR AS prediction_timestamp,
      CASE WHEN f.p >= 0.5 THEN 1 ELSE 0 END AS pred
    FROM prob f
    JOIN hourly n ON n.grid_id = f.grid_id AND n.timestamp = f.feature_timestamp + INTERVAL 1 HOUR
    JOIN median24 b ON b.grid_id = f.grid_id AND b.timestamp = f.feature_timestamp
    WHERE b.baseline_activity IS NOT NULL""",
    "train_end": """SELECT ft AS train_end FROM (SELECT ft, row_number() OVER (ORDER BY ft) AS rn, count(*) OVER () AS n
      FROM (SELECT DISTINCT feature_timestamp AS ft FROM wfeat) u) v
    WHERE rn = greatest(1, least(floor(n * 0.8::DOUBLE), n - 1))""",
    "compared": """SELECT l.grid_id, l.prediction_timestamp, l.pred, l.p, a.anomaly_score, a.anomaly_direction,
      a.total_activity, a.baseline_activity AS hour_baseline,
      coalesce(a.anomaly_flag, 0) AS odd, CASE WHEN k.grid_id IS NULL THEN 0 ELSE 1 END AS rule
    FROM labelled l
    LEFT JOIN anomalies a ON a.grid_id = l.grid_id AND a.timestamp = l.prediction_timestamp
    LEFT JOIN alert_keys k ON k.grid_id = l.grid_id AND k.timestamp = l.prediction_timestamp""",
    "categories": """SELECT *, CASE WHEN odd = 1 AND rule = 1 AND pred = 1 THEN 'ALL_THREE'
      WHEN odd = 1 AND rule = 1 THEN 'ML4_NP3' WHEN odd = 1 AND pred = 1 THEN 'ML4_ML3'
      WHEN rule = 1 AND pred = 1 THEN 'NP3_ML3' WHEN odd = 1 THEN 'ML4_ONLY'
      WHEN rule = 1 THEN 'NP3_ONLY' WHEN pred = 1 THEN 'ML3_ONLY' ELSE 'NONE' END AS comparison_category
    FROM compared""",
    "cells": f"SELECT CAST(c_custkey + 1 AS VARCHAR) AS grid_id, {square('c_custkey')} FROM customer",
    "some_cells": f"SELECT CAST(s_suppkey + 1 AS VARCHAR) AS grid_id, {square('s_suppkey')} FROM supplier",
    "boxes": """SELECT grid_id, (x0 + x1) / 2 AS centroid_longitude, (y0 + y1) / 2 AS centroid_latitude,
      'milano-grid.geojson#' || grid_id AS geometry_reference FROM some_cells""",
    "dim_time": """SELECT row_number() OVER (ORDER BY date, hour) AS time_key, date AS event_date, hour, day_of_week
    FROM (SELECT DISTINCT date, hour, day_of_week FROM fact) t""",
    "dim_grid": """SELECT row_number() OVER (ORDER BY g.grid_id) AS grid_key, g.grid_id, b.centroid_latitude,
      b.centroid_longitude, b.geometry_reference
    FROM (SELECT DISTINCT grid_id FROM fact) g LEFT JOIN boxes b ON b.grid_id = g.grid_id""",
    "answers": """SELECT conv_id, turn, CASE WHEN role <> 'user' THEN (conv_id % 50) / 100.0::DOUBLE END AS anomaly_score,
      'SEVERITY' || chr(10) || 'EVIDENCE' || chr(10) || '1. size ' || length(text) || '.25, share '
      || (conv_id % 100) || '%, turn -' || (conv_id * 3 + 40) || '.5' || chr(10) || text || chr(10)
      || 'INTERPRETATION' || chr(10) || text
      || CASE WHEN turn = 1 THEN chr(10) || 'This Indicates Congestion.' ELSE '' END
      || CASE WHEN role = 'system' THEN chr(10) || 'INSUFFICIENT EVIDENCE' ELSE '' END
      || CASE WHEN role = 'user' THEN '' ELSE chr(10) || 'NEXT CHECKS' || chr(10) || 'none' END AS response,
      [length(text) + 0.25::DOUBLE, CASE WHEN role <> 'user' THEN (conv_id % 50) / 100.0::DOUBLE END,
       conv_id + 0.5::DOUBLE] AS evidence
    FROM conversations""",
}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [name for name in CTES if name in words and re.search(
        rf"(FROM|JOIN)\s+{name}\b", sql)]


def assemble(body: str) -> str:
    """The body with the table expressions it needs, directly or through others, in order."""
    wanted, queue = set(), _needs(body)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue.extend(_needs(CTES[name]))
    listed = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in wanted)
    return f"WITH {listed}\n{body}" if listed else body
