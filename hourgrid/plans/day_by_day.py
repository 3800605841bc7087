"""The batch job on a store: each run takes in the new files and moves the tables on by what they bring.

Files are claimed first, then everything is written beside the old state, and one commit shows the new tables together with the
names of the files in them. A run that breaks before its commit changes no table; the next run takes its files again. One that
breaks behind its commit leaves claims that the next run settles in the audit log.
"""

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from hourgrid import schema as S
from hourgrid.operators import aggregate, alerts, anomaly, clean, gates, geo, incremental, learning, runs, warehouse
from hourgrid.session import cut_lineage, stored
from hourgrid.sources import files, sinks
from hourgrid.sources.snapshots import Change, Store

log = logging.getLogger("hourgrid.daily")

ACTIVITY, HOURLY, FEATURES, TAIL = "activity", "hourly_grid_summary", "network_feature_table", "series_tail"
TIMES, GRIDS, FACT = "dim_time", "dim_grid", "fact_network_activity"
DAYS, SKETCHES = "daily_totals", "daily_grid_sketches"
ANOMALIES, ALERTS, RISK, LOCATED = "network_anomaly_scores", "network_alerts", "network_risk_scores", "grid_activity_geo"
RISK_STORED = T.StructType([*S.RISK_SCHEMA.fields, T.StructField("date", T.DateType()), T.StructField("_version", T.LongType())])
CLAIM_SCHEMA = "filename string, run_id string, row_count long, claimed_at timestamp"


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that runs append to; empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def judge(spark: SparkSession, source: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every file of the landing folder with its status and reason, and the headers. `known` lists names taken before.

    A folder without files, or with an empty one, is refused.
    """
    found = files.discover_files(spark, source)
    zone = gates.raw_zone_check(found).first()
    if not zone["passed"]:
        raise ValueError(f"raw zone refused: {zone['files']} files, {zone['empty_files']} empty")
    lines = files.read_lines(spark, source)
    headers = cut_lineage(gates.file_headers(lines))
    checked = gates.header_gate(found.select("filename"), headers)
    rows = gates.row_gate(gates.fields_by_name(lines, headers))
    return cut_lineage(gates.route_files(checked, rows, known)), headers


def claim(spark: SparkSession, source: str, analytics: str, store: Store, run_id: str, now) -> tuple[list[str], DataFrame]:
    """Judge the files, note the new good ones as claimed, and return their names and their headers."""
    audit, claims = f"{analytics}/ingest_audit", f"{analytics}/ingest_claims"
    routed, headers = judge(spark, source, store.files())
    good = F.col("status") == "ACCEPTED"
    sinks.append_audit(routed.filter(~good), audit, now)
    mine = routed.filter(good).select(
        "filename", F.lit(run_id).alias("run_id"), "row_count", F.lit(now).cast("timestamp").alias("claimed_at"))
    names = sorted(r["filename"] for r in mine.select("filename").collect())
    if names:
        mine.write.mode("append").parquet(claims)
    return names, headers.join(mine.select("filename"), "filename", "left_semi")


def settle(spark: SparkSession, analytics: str, store: Store, now) -> None:
    """ACCEPTED rows in the audit log for claimed files that are committed and have none yet."""
    audit = f"{analytics}/ingest_audit"
    claims = appended(spark, f"{analytics}/ingest_claims", CLAIM_SCHEMA)
    known = appended(spark, audit, S.AUDIT_SCHEMA).filter("status = 'ACCEPTED'")
    done = claims.join(store.files(), "filename", "left_semi").join(known, "filename", "left_anti")
    rows = done.groupBy("filename").agg(F.max_by("row_count", "claimed_at").alias("row_count")).select(
        "filename", F.lit("ACCEPTED").alias("status"), "row_count", F.lit("QUALITY_VALID").alias("reason"))
    rows = cut_lineage(rows)  # its plan reads the log that it is added to
    if not rows.isEmpty():
        sinks.append_audit(rows, audit, now)


def cleaned(raw: DataFrame) -> tuple[DataFrame, dict]:
    """Clean activity and the counts of the run, in one scan of the text.

    The counts are observed while the parsed rows are written. That stage ends in files, so a task that runs again
    counts once; the number of written rows is compared all the same.
    """
    parsed = clean.parse_activity(raw)
    nulls = sum((F.count_if(F.col(m).isNull()) for m in S.MEASURES), F.lit(0)).cast("bigint").alias("nulls_handled")
    seen = Observation("run_counts")
    rows = stored(parsed.observe(seen, *clean.balance_counts(), nulls), "parsed")
    counts = seen.get
    if counts["raw_rows"] != rows.count():
        counts = rows.agg(*clean.balance_counts(), nulls).first().asDict()
    counts["balanced"] = counts["raw_rows"] == counts["clean_rows"] + counts["rejected_rows"]
    return clean.clean_parsed(rows), counts


def _rows_at(df: DataFrame, column: str) -> list:
    """Calendar days of a column: a list this short may pass through the driver."""
    return [r[0] for r in df.select(F.to_date(column)).distinct().collect()]


def advance(change: Change, activity: DataFrame) -> DataFrame:
    """Add clean activity to the store: activity, hourly sums, daily totals and sketches, features and series tails. Returns the changed
    feature rows.

    Reads the stored rows of the dates that the new rows touch, and the tails. Only for a grid with rows that come late
    are its stored hours read.
    """
    store = change.store
    hourly_schema = aggregate.hourly_grid(activity).select(*S.HOURLY_COLUMNS).schema
    touched = change.add(ACTIVITY, activity, sort=S.KEYS)
    added = change.written(ACTIVITY)
    change.replace(HOURLY, incremental.merged_hours(store.read(HOURLY, hourly_schema, touched), added), sort=S.KEYS)
    hours = change.written(HOURLY)

    totals = aggregate.dashboard_totals(hours)
    kept = store.read(DAYS, totals.schema).filter(~F.col("date").cast("string").isin(touched))
    change.replace_whole(DAYS, kept.unionByName(totals).coalesce(1))

    sketches = aggregate.grid_sketches(hours)
    kept = store.read(SKETCHES, sketches.schema).filter(~F.col("date").cast("string").isin(touched))
    change.replace_whole(SKETCHES, kept.unionByName(sketches).coalesce(1))

    series_schema = hours.select(*incremental.SERIES).schema
    tail = store.read(TAIL, series_schema)
    spans = stored(incremental.changed_spans(added), "spans")
    late = stored(incremental.late_grids(spans, tail).select("grid_id"), "late")
    ahead = hours.join(spans, "grid_id").filter(F.col("timestamp") >= F.col("first_change")).select(*incremental.SERIES)
    series = tail.join(spans, "grid_id", "left_semi").unionByName(ahead).join(late, "grid_id", "left_anti")
    if not late.isEmpty():
        series = series.unionByName(change.read(HOURLY).join(late, "grid_id", "left_semi").select(*incremental.SERIES))
    series = stored(series, "series")
    moved = stored(incremental.changed_features(series, spans).withColumn("date", F.to_date("feature_timestamp")), "moved")
    before = store.read(FEATURES, moved.schema, _rows_at(moved, "feature_timestamp"))
    change.replace(FEATURES, incremental.replaced_by_key(before, moved, ["grid_id", "feature_timestamp"]), sort=("grid_id", "feature_timestamp"))
    change.replace_whole(TAIL, tail.join(spans, "grid_id", "left_anti").unionByName(incremental.last_rows(series)))
    return moved


def advance_warehouse(change: Change, centroids: DataFrame | None = None) -> None:
    """Dimensions and facts of the hours that the change has written.

    Dimensions are made anew from their own rows and the new hours. While no key moves, only the facts of the touched dates
    are written; a new grid or an earlier date moves keys, and then all facts are.
    """
    store = change.store
    source = warehouse.warehouse_source(change.written(HOURLY))
    clock = source.select("date", "hour", "day_of_week")
    times = warehouse.dim_time(clock)
    old_times = store.read(TIMES, times.schema)
    grids = warehouse.dim_grid(source, centroids)
    old_grids = store.read(GRIDS, grids.schema)
    times = stored(warehouse.dim_time(clock.unionByName(old_times.select(F.col("event_date").alias("date"), "hour", "day_of_week"))), TIMES)
    grids = stored(warehouse.dim_grid(source.select("grid_id").unionByName(old_grids.select("grid_id")), centroids), GRIDS)
    change.replace_whole(TIMES, times)
    change.replace_whole(GRIDS, grids)
    moved = not (old_times.select("time_key", "event_date", "hour").exceptAll(times.select("time_key", "event_date", "hour")).isEmpty()
                 and old_grids.select("grid_key", "grid_id").exceptAll(grids.select("grid_key", "grid_id")).isEmpty())
    if moved:
        source = warehouse.warehouse_source(change.read(HOURLY))
    facts = warehouse.fact_activity(source, times, grids).withColumn("date", F.to_date("event_time"))
    change.replace(FACT, facts, sort=("grid_id", "event_time"))


def rebuild_histories(change: Change, lookup: DataFrame | None = None) -> None:
    """The tables whose every row depends on all of history: anomaly scores, alerts (their floor), hours with polygons."""
    hourly = change.read(HOURLY)
    change.replace(ANOMALIES, anomaly.anomaly_scores(hourly).withColumn("date", F.to_date("timestamp")), sort=S.KEYS)
    change.replace(ALERTS, alerts.rule_alerts(hourly).withColumn("date", F.to_date("timestamp")), sort=S.KEYS)
    if lookup is not None:
        located = geo.enriched(geo.attach_geometry(change.written(HOURLY), lookup))
        change.replace(LOCATED, located.withColumn("date", F.to_date("timestamp")), sort=S.KEYS)


def record_of(change: Change, counts: dict, run_id: str, now) -> DataFrame:
    """The status record of the run; the warehouse checks cover what the change has written."""
    spark = change.store.spark
    source = warehouse.warehouse_source(change.written(HOURLY))
    hours = change.written(HOURLY).select("date").distinct()
    fact = change.written(FACT).join(hours, "date", "left_semi")
    grids = change.written(GRIDS).join(source.select("grid_id").distinct(), "grid_id", "left_semi")
    failed = warehouse.warehouse_checks(source, grids, fact).filter(~F.col("passed")).count()
    facts = change.read(FACT).agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("as_of")).first()
    row = spark.createDataFrame(
        [(counts["raw_rows"], counts["rejected_rows"], counts["nulls_handled"], counts["balanced"], facts["n"], facts["as_of"], failed)],
        "rows_in long, rows_rejected long, nulls_handled long, balanced boolean, rows_published long, as_of timestamp, _failed long")
    return runs.publication_record(row, {
        "processed_activity_exists": F.col("rows_in") > F.col("rows_rejected"),
        "hourly_summary_exists": F.col("rows_published") > 0,
        "row_balance": F.col("balanced"),
        "warehouse_exists": F.col("_failed") == 0,
    }, "daily activity", run_id, now)


def take_in(spark, store: Store, names, headers, processed, analytics, lookup, run_id, now, model, version, at) -> DataFrame:
    """All stages of one run up to its commit; `at` is told which one runs."""
    at("spark_process")
    activity, counts = cleaned(files.read_by_header(spark, headers))
    sinks.write_table(spark.createDataFrame([counts]), f"{processed}/run_counts")
    change = store.begin()
    features = advance(change, activity)
    at("load_warehouse")
    advance_warehouse(change, geo.centroids_by_box(lookup) if lookup is not None else None)
    rebuild_histories(change, lookup)
    if model is not None:
        at("batch_score")
        learning.require_model_schema(model, features)
        scored = learning.with_probability(model, learning.require_scorable(features.drop("date")))
        change.add(RISK, learning.risk_rows(scored, version).withColumn("date", F.to_date("timestamp")), sort=S.KEYS)
    at("quality_check")
    record = stored(record_of(change, counts, run_id, now), "status")
    row = record.first()
    if row["status"] != "SUCCESS":
        raise RuntimeError(f"quality check failed: {row['reasons']}")
    change.commit(files=names)
    return record


def run(spark, source, processed, analytics, reference=None, run_id="manual", now=None, model=None, version="gbt-v1") -> DataFrame:
    """Take in the new good files of the landing folder; returns the status record.

    Refused files and those taken before are left out; a run without new files changes nothing. A stage that breaks
    leaves the tables as they were and a failure record that names it.
    """
    status = f"{analytics}/pipeline_status"
    stage = ["ingest"]
    try:
        store = Store(spark, analytics)
        settle(spark, analytics, store, now)
        names, headers = claim(spark, source, analytics, store, run_id, now)
        if not names:
            log.info("no new file")
            return files.read_status(spark, status)
        lookup = files.read_geojson(spark, reference) if reference else None
        record = take_in(spark, store, names, headers, processed, analytics, lookup, run_id, now, model, version,
                         lambda name: stage.__setitem__(0, name))
        stage[0] = "notify"
        settle(spark, analytics, store, now)
        sinks.write_report(store.read(DAYS).orderBy("date"), f"{analytics}/dashboard_summary", single_file=True)
        sinks.write_status(record, status)
    except Exception as error:
        sinks.write_status(runs.failure_record(spark, "daily activity", run_id, stage[0], str(error)[:500], str(now)), status)
        raise
    return files.read_status(spark, status)


def risk_scores(store: Store) -> DataFrame:
    """The newest score of each grid and hour."""
    return store.newest(RISK, S.KEYS, RISK_STORED)
