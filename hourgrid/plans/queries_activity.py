"""Registered queries: profile, cleaning, summaries and time series."""

from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import aggregate as A, clean, geo, profile, series
from hourgrid.plans.oracle import (
    D, MEASURES, R, SUM4, T, full_mean, ratio, rounded, trailing_mean,
)

_M = rounded(*MEASURES)
_TOT = rounded("total_sms", "total_calls", "total_activity")
_SUMS = rounded("total_sms", "total_calls", "internet_activity", "total_activity")
_SERIES = "PARTITION BY grid_id ORDER BY timestamp"
_NULLS = ["timestamp", "grid_id", "country_code", *MEASURES]
_NEGATIVE = " OR ".join(f"coalesce({m} < 0, false)" for m in MEASURES)
_TOTAL = " + ".join(f"coalesce({m}, 0)" for m in MEASURES)


def _busiest_point(ws):
    """The busiest grid and hour, as two scalars of one plan."""
    top = ws.hourly.orderBy(F.desc("total_activity"), "grid_id", "timestamp").limit(1)
    return top.select(F.struct("grid_id", "timestamp").alias("p")).scalar()


def _point_rows(ws):
    point = _busiest_point(ws)
    rows = ws.parsed.withColumn("hour_timestamp", F.date_trunc("hour", "timestamp"))
    return rows.filter(
        (F.col("hour_timestamp") == point.getField("timestamp"))
        & (F.col("grid_id") == point.getField("grid_id"))
    ).select("event_id", "grid_id", "timestamp", "country_code", *S.MEASURES)


def _temporal_columns(prefix=""):
    return rounded(*S.TEMPORAL_FEATURES, prefix=prefix)


_HAND = """SELECT count(*) AS groups, count(*) FILTER (coalesce(abs(h.total_activity + {shift} - r.again) > 1e-6, true)) AS mismatches
    FROM hourly h FULL JOIN (SELECT grid_id, date_trunc('hour', timestamp) AS ts, sum(coalesce(sms_in, 0) + coalesce(sms_out, 0)
      + coalesce(call_in, 0) + coalesce(call_out, 0) + coalesce(internet_activity, 0)) AS again FROM raw GROUP BY 1, 2) r
    ON r.grid_id = h.grid_id AND r.ts = h.timestamp"""

QUERIES = {
    "hotspot_top10": (
        lambda ws: A.hotspots_from_days(ws.hourly),
        f"""SELECT grid_id, {R('total_activity')} AS total_activity FROM (
            SELECT grid_id, sum(total_activity) AS total_activity FROM hourly GROUP BY 1) s
            ORDER BY s.total_activity DESC, grid_id LIMIT 10"""),
    # --- profile and cleaning
    "profile_counts": (
        lambda ws: profile.dataset_profile(ws.corrupted),
        """SELECT count(*) AS rows, count(DISTINCT grid_id) AS grids, count(DISTINCT country_code) AS countries,
            count(DISTINCT date_trunc('hour', timestamp)) AS hours FROM bad"""),
    "null_profile": (
        lambda ws: profile.null_profile(ws.corrupted, _NULLS),
        "SELECT " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in _NULLS) + ", "
        + " + ".join(f"(count(*) - count({c}))" for c in _NULLS) + " AS null_total FROM bad"),
    "negative_profile": (
        lambda ws: profile.negative_profile(ws.corrupted),
        "SELECT " + ", ".join(f"count(*) FILTER ({m} < 0) AS negative_{m}" for m in MEASURES)
        + " FROM bad"),
    "duplicate_rows": (
        lambda ws: profile.duplicate_rows(ws.corrupted),
        """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
            FROM (SELECT count(*) AS n FROM bad GROUP BY event_id, timestamp, grid_id, country_code, """
        + ", ".join(MEASURES) + ") g"),
    "point_rows": (
        _point_rows,
        f"""SELECT event_id, grid_id, {T('timestamp')} AS timestamp, country_code, {_M} FROM raw
            WHERE (grid_id, date_trunc('hour', timestamp)) = (SELECT (grid_id, timestamp) FROM hourly
              ORDER BY total_activity DESC, grid_id, timestamp LIMIT 1)"""),
    "reject_split_counts": (
        lambda ws: clean.reject_counts(ws.corrupted),
        f"""SELECT count(*) AS raw_rows, count(*) FILTER (reject_reason IS NULL) AS clean_rows,
            count(reject_reason) AS rejected_rows, count(*) - count(timestamp) AS null_timestamps,
            count(*) - count(grid_id) AS null_grids, count(*) FILTER ({_NEGATIVE}) AS negative_rows,
            true AS balanced FROM bad"""),
    "rejected_rows": (
        lambda ws: clean.split_rejects(ws.corrupted)[1].select(
            "event_id", "grid_id", "timestamp", "country_code", *S.MEASURES, "reject_reason"),
        f"""SELECT event_id, grid_id, {T('timestamp')} AS timestamp, country_code, {_M}, reject_reason
            FROM bad WHERE reject_reason IS NOT NULL"""),
    "lenient_clean_counts": (
        lambda ws: clean.reject_counts(ws.corrupted, mode="lenient").select(
            "raw_rows", "clean_rows", "rejected_rows"),
        f"""SELECT count(*) AS raw_rows, count(*) FILTER (timestamp IS NOT NULL AND NOT ({_NEGATIVE})) AS clean_rows,
            count(*) FILTER (timestamp IS NULL OR ({_NEGATIVE})) AS rejected_rows FROM bad"""),
    "grid_range_rejects": (
        lambda ws: clean.out_of_range_grids(ws.corrupted, 100).select(
            "event_id", "grid_id", "country_code"),
        """SELECT event_id, grid_id, country_code FROM bad
            WHERE grid_id IS NULL OR CAST(grid_id AS BIGINT) NOT BETWEEN 1 AND 100"""),
    "clean_activity": (
        lambda ws: A.union_days(clean.derive(clean.zero_fill(clean.split_rejects(ws.corrupted)[0])))
        .select("event_id", *S.KEYS, "country_code", *S.MEASURES, *S.TOTALS, "date",
                F.col("hour").cast("bigint").alias("hour"),
                F.col("day_of_week").cast("bigint").alias("day_of_week"),
                F.col("weekday").cast("bigint").alias("weekday"), "hour_timestamp"),
        f"""SELECT event_id, grid_id, {T('timestamp')} AS timestamp, country_code,
            {', '.join(f"{R(f'coalesce({m}, 0)')} AS {m}" for m in MEASURES)},
            {R('coalesce(sms_in, 0) + coalesce(sms_out, 0)')} AS total_sms,
            {R('coalesce(call_in, 0) + coalesce(call_out, 0)')} AS total_calls,
            {R(_TOTAL)} AS total_activity, {D('timestamp')} AS date, hour(timestamp) AS hour,
            dayofweek(timestamp) + 1 AS day_of_week, isodow(timestamp) - 1 AS weekday,
            {T("date_trunc('hour', timestamp)")} AS hour_timestamp
            FROM bad WHERE reject_reason IS NULL"""),
    "country_frequency": (
        lambda ws: profile.frequencies(ws.parsed, "country_code"),
        "SELECT country_code, count(*) AS rows FROM raw GROUP BY 1"),
    # --- summaries
    "hourly_grid": (
        lambda ws: A.geometry_free(ws.hourly),
        f"SELECT grid_id, {T('timestamp')} AS timestamp, {_M}, {_TOT}, {D('timestamp')} AS date FROM hourly"),
    "hourly_grid_null_mode": (
        lambda ws: A.hourly_grid(ws.parsed, null_mode="propagate", scale=4),
        "SELECT grid_id, " + T("t.timestamp") + " AS timestamp, "
        + rounded(*MEASURES, prefix="t.") + ", "
        + f"{R('t.sms_in + t.sms_out')} AS total_sms, {R('t.call_in + t.call_out')} AS total_calls, "
        + R("t.sms_in + t.sms_out + t.call_in + t.call_out + t.internet_activity")
        + f" AS total_activity, {D('t.timestamp')} AS date "
        + "FROM (SELECT grid_id, date_trunc('hour', timestamp) AS timestamp, "
        + ", ".join(f"sum({m}) AS {m}" for m in MEASURES) + " FROM raw GROUP BY 1, 2) t"),
    "daily_kpi": (
        lambda ws: A.daily_kpi(ws.hourly),
        f"""SELECT {D('date')} AS date, {_SUMS}, active_grids FROM (
            SELECT date, {SUM4}, count(DISTINCT grid_id) AS active_grids FROM hourly GROUP BY 1) s"""),
    "grid_kpi": (
        lambda ws: A.grid_kpi(ws.hourly),
        f"SELECT grid_id, {_SUMS} FROM (SELECT grid_id, {SUM4} FROM hourly GROUP BY 1) s"),
    "daily_traffic": (
        lambda ws: A.daily_traffic(ws.hourly),
        f"SELECT {D('date')} AS date, grid_id, {_SUMS} FROM (SELECT date, grid_id, {SUM4} FROM hourly GROUP BY 1, 2) s"),
    "dashboard_totals": (
        lambda ws: A.dashboard_totals(ws.hourly),
        f"SELECT {D('date')} AS date, {_SUMS} FROM (SELECT date, {SUM4} FROM hourly GROUP BY 1) s"),
    "dashboard_measures": (
        lambda ws: A.dashboard_measures(ws.hourly),
        f"SELECT {D('date')} AS date, {_M}, {R('total_activity')} AS total_activity FROM (SELECT date, "
        + ", ".join(f"sum({m}) AS {m}" for m in MEASURES + ["total_activity"])
        + " FROM hourly GROUP BY 1) s"),
    "peak_hour_of_day": (
        lambda ws: A.peak_hour_of_day(ws.hourly).withColumn("hour", F.col("hour").cast("bigint")),
        f"""SELECT hour, {R('total')} AS total_activity FROM (SELECT hour_of_day AS hour, sum(total_activity) AS total
            FROM hourly GROUP BY 1) s ORDER BY total DESC, hour LIMIT 1"""),
    "internet_share": (
        lambda ws: A.internet_share(ws.hourly),
        f"""SELECT {R('i')} AS internet_activity, {R('t')} AS total_activity, {R('i / t * 100')} AS internet_percent
            FROM (SELECT sum(internet_activity) AS i, sum(total_activity) AS t FROM hourly) s"""),
    "busiest_hour": (
        lambda ws: A.busiest_hours(ws.hourly),
        f"""SELECT {T('h')} AS timestamp, {R('total')} AS total_activity FROM (SELECT timestamp AS h,
            sum(total_activity) AS total FROM hourly GROUP BY 1) s ORDER BY total DESC, h LIMIT 1"""),
    "busiest_grid": (
        lambda ws: A.busiest_grids(ws.hourly),
        f"""SELECT grid_id, {R('total')} AS total_activity FROM (SELECT grid_id, sum(total_activity) AS total
            FROM hourly GROUP BY 1) s ORDER BY total DESC, grid_id LIMIT 1"""),
    "country_rows_per_grid_hour": (
        lambda ws: profile.country_rows(ws.parsed),
        f"""SELECT grid_id, {T('ts')} AS timestamp, n AS country_rows FROM (SELECT grid_id,
            date_trunc('hour', timestamp) AS ts, count(*) AS n FROM raw GROUP BY 1, 2) s"""),
    "grid_days": (
        lambda ws: A.grid_days(ws.hourly),
        f"SELECT DISTINCT grid_id, {D('date')} AS date FROM hourly"),
    "union_days": (
        lambda ws: A.dashboard_totals(A.hourly_grid(A.union_days(ws.parsed, ws.corrupted)
                                                    .dropna(subset=S.KEYS), scale=4)),
        f"""SELECT {D('date')} AS date, {_SUMS} FROM (SELECT CAST(timestamp AS DATE) AS date,
            sum(coalesce(sms_in, 0) + coalesce(sms_out, 0)) AS total_sms,
            sum(coalesce(call_in, 0) + coalesce(call_out, 0)) AS total_calls,
            sum(coalesce(internet_activity, 0)) AS internet_activity, sum({_TOTAL}) AS total_activity
            FROM (SELECT grid_id, timestamp, {', '.join(MEASURES)} FROM raw
                  UNION ALL SELECT grid_id, timestamp, {', '.join(MEASURES)} FROM bad) u
            WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL GROUP BY 1) s"""),
    "distinct_grids": (
        lambda ws: A.first_grids(ws.features),
        "SELECT grid_id FROM (SELECT DISTINCT grid_id FROM wfeat) g ORDER BY CAST(grid_id AS BIGINT) LIMIT 5"),
    "cadence_gaps": (
        lambda ws: profile.cadence_gaps(ws.corrupted),
        f"""SELECT {R('gap')} AS gap_hours, count(*) AS gaps FROM (
            SELECT (epoch(h) - epoch(lag(h) OVER (ORDER BY h))) / 3600.0::DOUBLE AS gap FROM (
              SELECT DISTINCT date_trunc('hour', timestamp) AS h FROM bad) d) g
            WHERE gap IS NOT NULL GROUP BY 1"""),
    "cadence_check": (
        lambda ws: profile.cadence_check(ws.parsed),
        """SELECT hours, days, days * 24 AS expected_hours, hours = days * 24 AS complete FROM (
            SELECT count(DISTINCT date_trunc('hour', timestamp)) AS hours,
            count(DISTINCT CAST(timestamp AS DATE)) AS days FROM raw) s"""),
    "grain_check": (
        lambda ws: A.grain_check(ws.corrupted),
        """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS duplicate_keys,
            count(*) FILTER (n > 1) = 0 AS passed
            FROM (SELECT count(*) AS n FROM bad GROUP BY grid_id, timestamp) g"""),
    "grain_bounds": (
        lambda ws: A.grain_bounds(ws.parsed, ws.hourly),
        """SELECT n AS hourly_rows, d AS days, r AS raw_rows, r - n AS removed_rows, d * 24 * 10000 AS max_rows,
            n <= d * 24 * 10000 AS within_bound FROM (SELECT count(*) AS n, count(DISTINCT date) AS d,
            (SELECT count(*) FROM raw) AS r FROM hourly) s"""),
    "hand_check": (
        lambda ws: A.recompute_check(ws.parsed, ws.hourly),
        _HAND.format(shift="0")),
    "hand_check_faulted": (
        lambda ws: A.recompute_check(ws.parsed, ws.hourly.withColumn("total_activity", F.col("total_activity") + F.when(
            F.hour("timestamp") == 5, 1.0).otherwise(0.0))),
        _HAND.format(shift="CASE WHEN hour(h.timestamp) = 5 THEN 1.0 ELSE 0.0 END")),
    # --- time series
    "previous_row": (
        lambda ws: series.previous_row(ws.hourly).select(*S.KEYS, "total_activity", "previous_activity"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R('total_activity')} AS total_activity,
            {R('p')} AS previous_activity FROM (SELECT *, lag(total_activity) OVER ({_SERIES}) AS p FROM hourly) s"""),
    "rolling_means": (
        lambda ws: series.rolling_means(ws.hourly).select(
            *S.KEYS, *[f"rolling_{n}h_activity" for n in (3, 6, 24)]),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {rounded(*[f'rolling_{n}h_activity' for n in (3, 6, 24)])}
            FROM (SELECT *, {', '.join(f'{full_mean(n)} AS rolling_{n}h_activity' for n in (3, 6, 24))} FROM hourly) s"""),
    "rolling_median": (
        lambda ws: series.rolling_baseline(ws.hourly).select(
            *S.KEYS, "baseline_activity", "high_activity_threshold"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R('m')} AS baseline_activity,
            {R('m * 1.5::DOUBLE')} AS high_activity_threshold FROM (SELECT grid_id, timestamp,
              CASE WHEN count(*) OVER w = 24 THEN quantile_cont(total_activity, 0.5) OVER w END AS m FROM hourly
              WINDOW w AS ({_SERIES} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) s"""),
    "activity_change": (
        lambda ws: series.activity_change(ws.hourly).select(
            *S.KEYS, "activity_change", "activity_change_pct"),
        f"""SELECT grid_id, {T('feature_timestamp')} AS timestamp,
            {rounded('activity_change', 'activity_change_pct')} FROM temporal"""),
    "feature_windows": (
        lambda ws: series.feature_windows(ws.hourly).withColumn(
            "active_hours", F.col("active_hours").cast("bigint")),
        f"""SELECT grid_id, {T('feature_timestamp')} AS feature_timestamp, {rounded('avg_activity', 'activity_growth')},
            CAST(active_hours AS BIGINT) AS active_hours, {rounded('peak_ratio', 'variability', 'internet_share')} FROM wfeat"""),
    "feature_table": (
        lambda ws: ws.features.withColumn("active_hours", F.col("active_hours").cast("bigint")),
        f"""SELECT grid_id, {T('feature_timestamp')} AS feature_timestamp, {rounded('avg_activity', 'activity_growth')},
            CAST(active_hours AS BIGINT) AS active_hours, {rounded('peak_ratio', 'variability', 'internet_share')},
            {_temporal_columns()} FROM features"""),
    "hour_range_features": (
        lambda ws: series.hour_range_features(ws.hourly),
        f"""SELECT grid_id, {T('timestamp')} AS feature_timestamp, {R('total_activity')} AS current_activity,
            {R('p')} AS previous_hour_activity, {R('r3')} AS rolling_3h_activity, {R('r6')} AS rolling_6h_activity,
            {R('total_activity - p')} AS activity_change, {R(ratio('total_activity - p', 'p'))} AS activity_change_pct
            FROM (SELECT h.*, coalesce(b.total_activity, 0.0) AS p, (SELECT avg(x.total_activity) FROM hourly x
              WHERE x.grid_id = h.grid_id AND x.timestamp BETWEEN h.timestamp - INTERVAL 2 HOURS AND h.timestamp) AS r3,
              (SELECT avg(x.total_activity) FROM hourly x
              WHERE x.grid_id = h.grid_id AND x.timestamp BETWEEN h.timestamp - INTERVAL 5 HOURS AND h.timestamp) AS r6
              FROM hourly h LEFT JOIN hourly b ON b.grid_id = h.grid_id AND b.timestamp = h.timestamp - INTERVAL 1 HOUR) s"""),
    "next_hour_gap": (
        lambda ws: series.next_hour_gap(ws.hourly),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {T('n')} AS next_timestamp,
            coalesce(n = timestamp + INTERVAL 1 HOUR, false) AS exact_next_hour
            FROM (SELECT *, lead(timestamp) OVER ({_SERIES}) AS n FROM hourly) s"""),
    "trailing_7d_mean": (
        lambda ws: series.trailing_7d_mean(ws.hourly).select(*S.KEYS, "mean_7d"),
        f"""SELECT grid_id, {T('timestamp')} AS timestamp, {R('m')} AS mean_7d
            FROM (SELECT grid_id, timestamp, {trailing_mean()} AS m FROM hourly) s"""),
    # --- polygons
    "grid_centroid_mean": (
        lambda ws: geo.centroids_by_vertex(ws.lookup),
        f"""SELECT grid_id, {R('(3 * x0 + 2 * x1) / 5')} AS centroid_longitude,
            {R('(3 * y0 + 2 * y1) / 5')} AS centroid_latitude FROM cells"""),
    "grid_centroid_bbox": (
        lambda ws: geo.centroids_by_box(ws.lookup),
        f"""SELECT grid_id, {R('(y0 + y1) / 2')} AS centroid_latitude, {R('(x0 + x1) / 2')} AS centroid_longitude,
            'milano-grid.geojson#' || grid_id AS geometry_reference FROM cells"""),
    "grid_neighbour_distance": (
        lambda ws: geo.neighbour_distances(ws.lookup),
        f"""SELECT a.grid_id, b.grid_id AS next_grid_id, {R('sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0))')} AS distance
            FROM cells a JOIN cells b ON CAST(b.grid_id AS BIGINT) = CAST(a.grid_id AS BIGINT) + 1"""),
    "unmatched_grids": (
        lambda ws: geo.unmatched_grids(ws.hourly, ws.partial_lookup),
        "SELECT DISTINCT grid_id FROM hourly WHERE grid_id NOT IN (SELECT grid_id FROM some_cells)"),
    "join_validation": (
        lambda ws: geo.join_validation(
            ws.hourly, geo.attach_geometry(ws.hourly, ws.partial_lookup)),
        f"""SELECT n AS rows_after, g AS grids_after, m AS missing_grids, n AS rows_before, g AS grids_before,
            {R('(g - m) * 100.0::DOUBLE / g')} AS coverage_percent, true AS rows_kept, true AS grids_kept
            FROM (SELECT count(*) AS n, count(DISTINCT grid_id) AS g, count(DISTINCT grid_id) FILTER
              (grid_id NOT IN (SELECT grid_id FROM some_cells)) AS m FROM hourly) s"""),
}


def _corner(ws, strategy, lookup):
    """Enriched rows, the polygon shown by its first corner."""
    rows = geo.enriched(geo.attach_geometry(ws.hourly, lookup, strategy))
    return _first_corner(rows.select("grid_id", "timestamp", "total_activity", "geometry"))


def _first_corner(rows):
    at = [F.get_json_object("geometry", f"$.coordinates[0][0][{i}]").cast("double") for i in (0, 1)]
    return rows.withColumns({"corner_longitude": at[0], "corner_latitude": at[1]}).drop("geometry")


_enriched_sql = f"""SELECT h.grid_id, {T('h.timestamp')} AS timestamp, {R('h.total_activity')} AS total_activity,
    {R('c.x0')} AS corner_longitude, {R('c.y0')} AS corner_latitude
    FROM hourly h LEFT JOIN some_cells c ON c.grid_id = h.grid_id"""

QUERIES |= {
    "enriched_hourly": (lambda ws: _corner(ws, "auto", ws.partial_lookup), _enriched_sql),
    "enriched_hourly_shuffle": (lambda ws: _corner(ws, "merge", ws.partial_lookup), _enriched_sql),
    "top_grids_geo": (
        lambda ws: _first_corner(geo.top_grids_with_geometry(ws.hourly, ws.lookup)),
        f"""SELECT t.grid_id, {R('t.total')} AS total_activity, {R('c.x0')} AS corner_longitude,
            {R('c.y0')} AS corner_latitude FROM (SELECT grid_id, sum(total_activity) AS total FROM hourly GROUP BY 1
              ORDER BY 2 DESC, 1 LIMIT 10) t LEFT JOIN cells c ON c.grid_id = t.grid_id"""),
}
