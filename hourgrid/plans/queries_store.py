"""Registered queries that write files and tables to the session's shared folder and read them back."""

import uuid

from pyspark.sql import Window as W, functions as F

from hourgrid import schema as S
from hourgrid.operators import aggregate, clean, gates, geo, runs
from hourgrid.plans import day_by_day
from hourgrid.plans.fixtures import SCALE, Workspace
from hourgrid.plans.oracle import D, R, T, rounded
from hourgrid.plans.queries_activity import QUERIES as ACTIVITY
from hourgrid.plans.queries_rules import QUERIES as RULES, _rescored
from hourgrid.session import shared_folder
from hourgrid.sources import files, sinks
from hourgrid.sources.snapshots import Store

# Column orders of daily files, by the day of the month modulo four; the last one lacks a column.
ORDERS = [S.RAW_COLUMNS, S.RAW_COLUMNS[::-1], ["note", *S.RAW_COLUMNS[3:], *S.RAW_COLUMNS[:3], "more"], S.RAW_COLUMNS[:-1]]
PARTS = 3


def _folder(ws: Workspace, name: str) -> str:
    return f"{shared_folder(ws.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _activity_by_header(ws: Workspace):
    folder = _folder(ws, "files")
    day = F.dayofmonth("datetime")
    for i, columns in enumerate(ORDERS):
        rows = ws.raw.filter(day % len(ORDERS) == i).withColumns({"note": F.lit("a, b"), "more": F.lit(7)})
        rows.select(*columns).write.option("header", True).csv(f"{folder}/{i}")
    headers = gates.file_headers(files.read_lines(ws.spark, f"{folder}/*", "*.csv"))
    return clean.parse_activity(files.read_by_header(ws.spark, headers)).drop("source_file")


def _taken_in(ws: Workspace) -> Store:
    """A store that took the activity in by parts: three spans of days, with every 40th row of the first two in the last. A
    change for the second part broke before its commit and was made again."""
    store = Store(ws.spark, _folder(ws, "store"))
    day = F.dayofmonth("timestamp")
    part = F.when((F.col("event_id") % 40 == 0) | (day > 20), 2).when(day > 10, 1).otherwise(0)
    rows = ws.parsed.withColumn("_part", part)
    for i in range(PARTS):
        activity = clean.clean_parsed(rows.filter(F.col("_part") == i))
        if i == 1:
            store.begin().add(day_by_day.ACTIVITY, activity)
        change = store.begin()
        day_by_day.advance(change, activity)
        change.commit(files=[f"part {i}"])
    return store


def _hourly(ws: Workspace):
    rows = _taken_in(ws).read(day_by_day.HOURLY)
    return rows.withColumns({c: F.round(c, SCALE) for c in S.MEASURES + S.TOTALS})


def _features(ws: Workspace):
    return _taken_in(ws).read(day_by_day.FEATURES).withColumn("active_hours", F.col("active_hours").cast("bigint")).drop("date")


def _grids_so_far(ws: Workspace):
    """Distinct grids up to each date from merged sketches, against an exact count of first days."""
    hourly = ws.stored.hourly
    guess = aggregate.grids_up_to(aggregate.grid_sketches(hourly))
    first = hourly.groupBy("grid_id").agg(F.min("date").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("new"))
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a date
    both = guess.join(first, "date", "left").withColumn("exact", F.coalesce(F.sum("new").over(so_far), F.lit(0)))
    close = F.abs(F.col("grids_so_far") - F.col("exact")) <= F.col("exact") * 0.03
    return both.select("date", F.col("exact").alias("grids"), close.alias("within_3_percent"))


def _file_listing(ws: Workspace):
    """Files of one row group each, an empty one among them: names, lengths above zero, and rows by file from the lineage column."""
    folder = _folder(ws, "listed")
    ws.raw.select(*S.RAW_COLUMNS, F.concat(F.lit("d"), F.dayofmonth("datetime").cast("string")).alias("day")).repartition("day").write.partitionBy(
        "day").option("header", True).csv(folder)
    read = ws.spark.read.option("header", True).schema(S.RAW_TEXT_SCHEMA).csv(folder)
    lineage = read.withColumn("path", F.col("_metadata.file_path")).groupBy("path", "day").agg(F.count(F.lit(1)).alias("rows"))
    found = files.discover_files(ws.spark, f"{folder}/*", "*.csv").withColumn("day", F.regexp_extract("path", "day=(d[0-9]+)", 1))
    zone = gates.raw_zone_check(found)
    by_day = lineage.groupBy("day").agg(F.sum("rows").alias("rows")).join(
        found.groupBy("day").agg((F.min("length") > 0).alias("has_bytes")), "day")
    return by_day.withColumn("zone_passed", zone.select("passed").scalar())


def _polygons_read(ws: Workspace):
    """The customer cells written as GeoJSON documents of at most a thousand cells and read as a lookup, with their centres."""
    folder = _folder(ws, "grid")
    cell = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("grid_id").alias("cellId")).alias("properties"),
                              F.from_json("geometry", "type string, coordinates array<array<array<double>>>").alias("geometry")))
    block = F.floor(F.col("grid_id").cast("bigint") / 1000).alias("block")
    documents = ws.lookup.select(block, cell.alias("f")).groupBy("block").agg(F.concat(
        F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    documents.write.partitionBy("block").text(folder)  # a document a file
    return geo.centroids_by_box(files.read_geojson(ws.spark, folder)).select("grid_id", "centroid_latitude", "centroid_longitude")


def _summaries_read(ws: Workspace):
    """The exported daily and grid summaries as read back from their CSV files, one row for each file's sum."""
    hourly, folder = ws.stored.hourly, _folder(ws, "export")
    sinks.export_summaries(hourly, aggregate.daily_kpi(hourly), aggregate.grid_kpi(hourly), folder)
    read = {n: ws.spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{n}")
            for n in ("daily_summary", "grid_summary", "grid_hour_summary")}
    sums = [df.agg(F.lit(n).alias("summary"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("total_activity"), 2).alias("total_activity"))
            for n, df in read.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


def _table_round_trip(ws: Workspace):
    """The hourly table written by date: its partitions, and rows and types as read back."""
    hourly, path = ws.stored.hourly, _folder(ws, "by_date")
    sinks.write_by_date(hourly, path)
    back = ws.spark.read.parquet(path)
    passed = sinks.round_trip_check(hourly.select(*back.columns), path).select("passed").scalar()
    return files.partition_values(back).select("date", "rows").withColumn("passed", passed)


def _status_read(ws: Workspace):
    """A status record made of the activity's counts, written as JSON and read back."""
    counts = clean.reject_counts(ws.stored.corrupted).select(
        F.col("raw_rows").alias("rows_in"), F.col("rejected_rows").alias("rows_rejected"), F.lit(0).alias("nulls_handled"),
        F.col("clean_rows").alias("rows_published"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("as_of"), "balanced")
    path = _folder(ws, "status")
    sinks.write_status(runs.publication_record(counts, {"row_balance": F.col("balanced"), "all_clean": F.col("rows_rejected") == 0},
                                               "daily activity", "r1", "2024-02-01 00:00:00"), path)
    return files.read_status(ws.spark, path).select(
        "status", "quality_check", "rows_in", "rows_rejected", "rows_published", F.array_join("reasons", ",").alias("reasons"))


def _added_scores(ws: Workspace):
    """Scores, then new ones for some keys, added as changes; one date range folded in between."""
    store = Store(ws.spark, _folder(ws, "scores"))
    for i, rows in enumerate((ws.risk, _rescored(ws))):
        change = store.begin()
        change.add(day_by_day.RISK, rows.withColumn("date", F.to_date("timestamp")))
        change.commit(token=f"batch {i}")
    store.compact(day_by_day.RISK, S.KEYS)
    return day_by_day.risk_scores(store).select(*S.RISK_SCHEMA.fieldNames())


QUERIES = {
    "activity_by_header": (
        _activity_by_header,
        f"""SELECT {T('timestamp')} AS timestamp, grid_id, country_code, {rounded(*S.MEASURES)} FROM raw WHERE day(timestamp) % 4 <> 3"""),
    "hourly_day_by_day": (_hourly, ACTIVITY["hourly_grid"][1]),
    "features_day_by_day": (_features, ACTIVITY["feature_table"][1]),
    "grids_so_far": (
        _grids_so_far,
        f"""SELECT {D('d.date')} AS date, (SELECT count(DISTINCT grid_id) FROM hourly h WHERE h.date <= d.date) AS grids,
            true AS within_3_percent FROM (SELECT DISTINCT date FROM hourly) d"""),
    "file_listing": (
        _file_listing,
        "SELECT 'd' || day(timestamp) AS day, count(*) AS rows, true AS has_bytes, true AS zone_passed FROM raw GROUP BY 1"),
    "polygons_read": (
        _polygons_read,
        f"SELECT grid_id, {R('(y0 + y1) / 2')} AS centroid_latitude, {R('(x0 + x1) / 2')} AS centroid_longitude FROM cells"),
    "summaries_read": (
        _summaries_read,
        """SELECT 'daily_summary' AS summary, count(DISTINCT date) AS rows, round(sum(total_activity), 2) AS total_activity FROM hourly
            UNION ALL SELECT 'grid_summary', count(DISTINCT grid_id), round(sum(total_activity), 2) FROM hourly
            UNION ALL SELECT 'grid_hour_summary', count(*), round(sum(total_activity), 2) FROM hourly"""),
    "table_round_trip": (
        _table_round_trip, f"SELECT {D('date')} AS date, count(*) AS rows, true AS passed FROM hourly GROUP BY 1"),
    "status_read": (
        _status_read,
        """SELECT 'FAILED' AS status, 'FAIL' AS quality_check, count(*) AS rows_in, count(reject_reason) AS rows_rejected,
            count(*) - count(reject_reason) AS rows_published, 'all_clean' AS reasons FROM bad"""),
    "added_scores": (_added_scores, RULES["upsert_scores"][1]),
}
