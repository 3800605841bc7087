"""Sources, sinks and file gates on real files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import aggregate, clean, gates, geo, runs, serving
from hourgrid.plans import daily
from hourgrid.session import shared_folder
from hourgrid.sources import files, sinks
from hourgrid.sources.snapshots import Store

HEADER = ",".join(S.RAW_COLUMNS)


def name(day):
    return f"sms-call-internet-mi-2013-11-{day:02d}.csv"


def write(folder, day, lines, header=HEADER):
    text = "\n".join([header, *lines]) if header is not None else ""
    (folder / name(day)).write_text(text + ("\n" if text else ""))


def good(hour, cell=1, day=1, value="1.5"):
    return f"2013-11-{day:02d} {hour:02d}:00:00,{cell},39,{value},,0.5,,2"


@pytest.fixture
def landing(tmp_path):
    write(tmp_path, 1, [good(0), good(1), good(0, 2)])
    write(tmp_path, 2, [good(0, day=2), "", "broken,1,39,,,,,", good(1)])
    write(tmp_path, 3, [good(0), "2013-11-03 00:00:00,10001,39,,,,,"])
    write(tmp_path, 4, [good(0), good(0), "2013-11-04,x,39,,,,,"])
    write(tmp_path, 5, [",1,39,,,,,"])
    write(tmp_path, 6, ["2013-11-06 00:00:00,1,39,abc,,,,"])
    write(tmp_path, 7, ["2013-11-07 00:00:00,1,39,1,,-2,,"])
    write(tmp_path, 8, [], header=HEADER)
    write(tmp_path, 9, [good(0)], header=HEADER.replace("callout", "other"))
    write(tmp_path, 10, [], header=None)
    # Other column order, a byte order mark and quoted fields.
    write(tmp_path, 11, ['"7","2013-11-11T03:00:00Z",39,"1.0",,,,"2,5"', "7,2013-11-11,39,nan,,1e3,,.5"],
          header="﻿CellID,datetime,countrycode,smsin,smsout,callin,callout,internet")
    (tmp_path / "milano-grid.geojson").write_text("{}")
    return tmp_path


def judged(spark, landing, known=()):
    found = files.discover_files(spark, str(landing))
    lines = files.read_lines(spark, str(landing))
    headers = gates.file_headers(lines)
    checked = gates.header_gate(found, headers)
    rows = gates.row_gate(gates.fields_by_name(lines, headers))
    manifest = spark.createDataFrame([(n,) for n in known], "filename string")
    return gates.route_files(checked, rows, manifest)


def test_discovery_leaves_out_other_files(spark, landing):
    found = [r["filename"] for r in files.discover_files(spark, str(landing)).collect()]
    assert found == [name(d) for d in range(1, 12)]
    check = gates.raw_zone_check(files.discover_files(spark, str(landing))).first()
    assert (check["files"], check["empty_files"], check["passed"]) == (11, 1, False)


def test_gates_and_routing(spark, landing):
    got = {r["filename"]: (r["status"], r["row_count"], r["reason"])
           for r in judged(spark, landing, [name(1), name(2)]).collect()}
    assert got == {
        name(1): ("DUPLICATE", 3, "FILE_ALREADY_EXISTS_IN_RAW"),
        name(2): ("REJECTED", 2, "MALFORMED_TIMESTAMP_AT_ROW_3"),
        name(3): ("REJECTED", 2, "CELLID_OUT_OF_RANGE_AT_ROW_3"),
        name(4): ("REJECTED", 3, "INVALID_CELLID_AT_ROW_4"),
        name(5): ("REJECTED", 1, "MISSING_TIMESTAMP_AT_ROW_2"),
        name(6): ("REJECTED", 1, "NON_NUMERIC_smsin_AT_ROW_2"),
        name(7): ("REJECTED", 1, "NEGATIVE_callin_AT_ROW_2"),
        name(8): ("REJECTED", 0, "NO_DATA_ROWS"),
        name(9): ("REJECTED", 0, "MISSING_COLUMNS:callout"),
        name(10): ("REJECTED", 0, "EMPTY_FILE"),
        name(11): ("REJECTED", 1, "NON_NUMERIC_internet_AT_ROW_2"),
    }


def test_first_failure_across_blocks(spark, tmp_path):
    """One file read in many blocks: the row number counts rows of all blocks before."""
    lines = [good(i % 24, cell=i % 500 + 1) for i in range(4000)]
    lines[2901] = good(0, cell=0)
    lines[3500] = good(0, cell="x")
    write(tmp_path, 1, lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert files.read_lines(spark, str(tmp_path)).select("block").distinct().count() > 5
        row = judged(spark, tmp_path).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row["row_count"], row["reason"]) == (2902, "CELLID_OUT_OF_RANGE_AT_ROW_2903")


def test_audit_log_grows(spark, landing, tmp_path):
    log = str(tmp_path / "log")
    for stamp in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        sinks.append_audit(judged(spark, landing), log, stamp)
    stored = spark.read.parquet(log)
    assert stored.schema.fieldNames() == S.AUDIT_SCHEMA.fieldNames()
    assert stored.count() == 22 and stored.select("processed_at").distinct().count() == 2


def test_read_activity(spark, landing):
    raw = files.read_activity(spark, f"{landing}/{name(1)}")
    assert raw.columns == S.RAW_COLUMNS + ["source_file"]
    assert {r["source_file"] for r in raw.collect()} == {name(1)}
    assert clean.parse_activity(raw).filter("timestamp IS NULL OR sms_in IS NULL").count() == 0
    with pytest.raises(Exception, match="(?i)no activity file|path.*not.*exist"):
        files.read_activity(spark, str(landing), "nothing-*.csv")


def test_activity_source_takes_exactly_one(spark, landing):
    frame = files.activity_source(spark, path=f"{landing}/{name(1)}")
    assert files.activity_source(spark, frame=frame) is frame
    for args in ({}, {"path": "x", "frame": frame}):
        with pytest.raises(ValueError):
            files.activity_source(spark, **args)


def geojson(path, cells):
    def feature(i, kind="Polygon"):
        ring = [[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]
        shape = [ring] if kind == "Polygon" else [[ring]]
        return {"id": 900 + i, "type": "Feature", "properties": {"cellId": i},
                "geometry": {"type": kind, "coordinates": shape}}

    features = [feature(i) for i in range(1, cells)] + [feature(cells, "MultiPolygon")]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    return str(path)


def test_geojson(spark, tmp_path):
    path = geojson(tmp_path / "grid.geojson", 5)
    lookup = files.read_geojson(spark, path, expected=5)
    assert sorted(r["grid_id"] for r in lookup.collect()) == ["1", "2", "3", "4", "5"]
    means = {r["grid_id"]: r["centroid_longitude"] for r in geo.centroids_by_vertex(lookup).collect()}
    assert means["5"] == pytest.approx(5.4)
    assert geo.centroids_by_box(lookup).count() == 4
    with pytest.raises(ValueError, match="5 cells"):
        files.read_geojson(spark, path, expected=10_000)
    distances = geo.neighbour_distances(lookup).collect()
    assert len(distances) == 4 and all(r["distance"] == pytest.approx(1.0) for r in distances)


def test_geometry_join_strategies(spark):
    small = spark.range(10).select(F.col("id").cast("string").alias("grid_id"), F.lit("{}").alias("geometry"))
    rows = spark.range(100).select(F.col("id").cast("string").alias("grid_id"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(geo.attach_geometry(rows, small, "merge"))
    assert geo.attach_geometry(rows, small).count() == 100
    with pytest.raises(ValueError):
        geo.attach_geometry(rows, small, "other")


def test_geojson_repeated_id_by_rule(spark, tmp_path):
    cell = lambda i, x: {"type": "Feature", "properties": {"cellId": i}, "geometry": {"type": "Point", "coordinates": [x, 0]}}
    path = tmp_path / "twice.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [cell(1, 9), cell(1, 2), cell(2, 3)]}))
    got = {r["grid_id"]: json.loads(r["geometry"])["coordinates"][0] for r in files.read_geojson(spark, str(path)).collect()}
    assert got == {"1": 2, "2": 3}


def scores(spark, rows):
    return spark.createDataFrame(rows, "grid_id string, t string, risk_score double").select(
        "grid_id", F.to_timestamp("t").alias("timestamp"), "risk_score",
        F.lit("LOW").alias("risk_level"), F.lit("v1").alias("model_version"))


def test_upsert_touches_only_its_dates(spark, tmp_path):
    shared_folder(spark)
    path = str(tmp_path / "risk")
    first = scores(spark, [("1", "2024-01-01 00:00:00", 0.1), ("2", "2024-01-01 00:00:00", 0.2),
                           ("1", "2024-01-02 00:00:00", 0.3)])
    sinks.write_by_date(first.withColumn("date", F.to_date("timestamp")), path)
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "risk" / "date=2024-01-02").iterdir()}
    sinks.upsert_by_date(spark, scores(spark, [("1", "2024-01-01 00:00:00", 0.9),
                                               ("3", "2024-01-01 05:00:00", 0.4)]), path)
    got = {(r["grid_id"], str(r["timestamp"])): r["risk_score"] for r in spark.read.parquet(path).collect()}
    assert got == {("1", "2024-01-01 00:00:00"): 0.9, ("2", "2024-01-01 00:00:00"): 0.2,
                   ("3", "2024-01-01 05:00:00"): 0.4, ("1", "2024-01-02 00:00:00"): 0.3}
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "risk" / "date=2024-01-02").iterdir()}
    assert after == untouched
    listed = files.partition_values(spark.read.parquet(path)).orderBy("date").collect()
    assert [(r["date"], r["rows"]) for r in listed] == [("2024-01-01", 3), ("2024-01-02", 1)]


def test_upsert_refuses_null_and_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "risk")
    good = scores(spark, [("1", "2024-01-01 00:00:00", 0.1)])
    sinks.upsert_by_date(spark, good, path)  # makes the table
    for rows in ([("1", "2024-01-01 00:00:00", 0.2)] * 2, [("2", None, 0.2)], [(None, "2024-01-01 00:00:00", 0.2)]):
        with pytest.raises(ValueError):
            sinks.upsert_by_date(spark, scores(spark, rows), path)
    assert [r["risk_score"] for r in spark.read.parquet(path).collect()] == [0.1]


def test_large_date_is_split(spark, tmp_path):
    """One date with nearly all rows goes to several files; the rebalance hint splits it."""
    rows = spark.range(400_000).select(
        F.xxhash64("id").cast("string").alias("grid_id"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("timestamp"),
        F.when(F.col("id") > 100, F.lit("2024-01-01")).otherwise("2024-01-02").cast("date").alias("date"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        sinks.write_by_date(rows, str(tmp_path / "t"))
    finally:
        spark.conf.set(key, before)
    listed = files.partition_values(spark.read.parquet(str(tmp_path / "t"))).collect()
    found = {r["date"]: (r["files"], r["rows"]) for r in listed}
    assert found["2024-01-01"][0] > 1 and found["2024-01-01"][1] == 399_899
    assert found["2024-01-02"] == (1, 101)


def test_tables_reports_and_round_trip(spark, tmp_path, hourly):
    df = hourly(("1", "2024-01-01 00:00:00", range(30)))
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    assert sinks.round_trip_check(df, path).first()["passed"]
    assert not sinks.round_trip_check(df.limit(3), path).first()["passed"]
    sinks.write_report(df.limit(3), str(tmp_path / "csv"), single_file=True)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns
    sinks.replace_table(df.limit(5), "small_hours")
    sinks.replace_table(df.limit(4), "small_hours")
    assert files.table_columns(spark, "small_hours", ["grid_id"]) == df.columns
    assert spark.table("small_hours").count() == 4
    with pytest.raises(LookupError):
        files.table_columns(spark, "no_such_table")
    with pytest.raises(ValueError):
        files.table_columns(spark, "small_hours", ["absent"])
    spark.sql("DROP TABLE small_hours")


def test_export_refuses_repeated_hours(spark, tmp_path, hourly):
    df = hourly(("1", "2024-01-01 00:00:00", range(3)))
    days = df.groupBy("date").count()
    sinks.export_summaries(df, days, df.groupBy("grid_id").count(), str(tmp_path / "out"))
    stored = spark.read.option("header", True).csv(str(tmp_path / "out" / "grid_hour_summary"))
    assert stored.count() == 3 and stored.columns[:2] == ["grid_id", "timestamp"]
    with pytest.raises(ValueError):
        sinks.export_summaries(df.union(df), days, days, str(tmp_path / "again"))


def test_status_records(spark, tmp_path):
    path = str(tmp_path / "failed")
    sinks.write_status(runs.failure_record(
        spark, "p", "r1", "validate", "boom", "2024-01-01T00:00:00"), path)
    record = files.read_status(spark, path)
    row = runs.run_status(record, "2024-01-01 10:00:00").first()
    assert not row["healthy"] and row["rows_in"] == 0
    assert row["reasons"] == ["Pipeline status is FAILED", "Quality check status is FAIL",
                              "Failed task: validate"]
    assert row["task_status"] == {
        "ingest": "UNKNOWN", "validate": "FAILED", "spark_process": "UNKNOWN",
        "load_warehouse": "UNKNOWN", "quality_check": "FAILED", "notify": "UNKNOWN"}
    other = runs.failure_record(spark, "p", "r1", "batch_score", "boom", "2024-01-01T00:00:00")
    assert runs.run_status(other, "2024-01-01").first()["task_status"]["batch_score"] == "FAILED"


def test_daily_job(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for day in (1, 2, 3):
        lines = [f"2013-11-{day:02d} {h:02d}:00:00,{c},{k},{h}.5,{c},1,,{k}"
                 for h in range(24) for c in (1, 2) for k in (39, 40)]
        write(landing, day, lines + [f"2013-11-{day:02d} 00:00:00,,39,1,,,,", f"bad,1,39,1,,,,",
                                     f"2013-11-{day:02d} 00:00:00,1,39,-1,,,,"])
    grid = geojson(tmp_path / "grid.geojson", 10_000)
    out = str(tmp_path / "analytics")
    record = daily.run(spark, str(landing), str(tmp_path / "clean"), out, grid,
                       now="2013-11-04 00:00:00").first()
    assert (record["rows_in"], record["rows_rejected"], record["rows_published"]) == (297, 9, 144)
    assert record["healthy"] and record["as_of"] == "2013-11-03T23:00:00"
    hours = spark.read.parquet(f"{out}/hourly_grid_summary")
    assert aggregate.grain_check(hours).first()["passed"]
    assert sorted(r["date"].isoformat() for r in hours.select("date").distinct().collect()) == [
        "2013-11-01", "2013-11-02", "2013-11-03"]
    one = hours.filter("grid_id = '2' AND hour(timestamp) = 3").first()
    assert (one["sms_in"], one["sms_out"], one["internet_activity"]) == (7.0, 4.0, 79.0)
    assert spark.read.parquet(f"{out}/network_feature_table").count() == 2 * (72 - 47)
    assert spark.read.parquet(f"{out}/dim_grid").filter("geometry_reference IS NULL").count() == 0
    assert spark.read.parquet(f"{out}/grid_activity_geo").filter("geometry IS NULL").count() == 0

    fact = spark.read.parquet(f"{out}/fact_network_activity")
    odd = spark.read.parquet(f"{out}/network_anomaly_scores")
    risk = odd.select("grid_id", "timestamp", "date", F.lit(0.5).alias("risk_score"),
                      F.lit("ATTENTION").alias("risk_level"), F.lit("v").alias("model_version"))
    top = serving.hotspots(fact, risk, "2013-11-02 05:00:00", limit=5)
    assert {(r["grid_id"], r["total_activity"], r["risk_level"]) for r in top.collect()} == {
        ("1", 94.0, "ATTENTION"), ("2", 96.0, "ATTENTION")}
    plan = top.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == 3  # facts (rows and keys) and scores of one date
    assert serving.grid_drilldown(fact, 2, "2013-11-02 05:00:00").count() == 24
    assert serving.network_summary(fact).first()["active_grids"] == 2


def test_gated_daily_job(spark, tmp_path):
    """Good, faulty, short and repeated files; a second run changes nothing; a broken run leaves its record."""
    from hourgrid.operators import learning

    landing, out, clean_to = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "clean")
    landing.mkdir()

    def day(d, extra=()):
        write(landing, d, [f"2013-11-{d:02d} {h:02d}:00:00,{c},39,{h % 7}.5,{c},1,{h * c % 11},2"
                           for h in range(24) for c in (1, 2)] + list(extra))

    for d in (1, 2, 3, 4):
        day(d)
    day(5, ["bad,1,39,1,,,,"])
    short = landing / "sms-call-internet-mi-2013-11-06.csv"
    short.write_text("datetime,CellID\n2013-11-06 00:00:00,1\n")
    record = daily.run(spark, str(landing), clean_to, out, now="2013-11-07 00:00:00", gated=True).first()
    assert record["healthy"] and record["rows_in"] == 4 * 48
    audit = {r["filename"][-6:-4]: (r["status"], r["row_count"]) for r in spark.read.parquet(f"{out}/ingest_audit").collect()}
    assert audit["01"] == ("ACCEPTED", 48) and audit["05"] == ("REJECTED", 49) and audit["06"][0] == "REJECTED"
    before = sorted(p.name for p in (tmp_path / "out" / "data").rglob("*.parquet"))
    assert before
    again = daily.run(spark, str(landing), clean_to, out, now="2013-11-08 00:00:00", gated=True).first()
    assert again["timestamp"] == record["timestamp"]
    assert sorted(p.name for p in (tmp_path / "out" / "data").rglob("*.parquet")) == before
    features = Store(spark, out).read("network_feature_table")
    labelled = features.withColumn("HIGH_ACTIVITY", (F.hour("feature_timestamp") % 2).cast("int"))
    model = learning.fit_classifier(labelled, trees=2)
    risk = daily.score(spark, {"network_feature_table": features}, out, model, "v1")
    assert risk.count() == features.count()
    assert daily.score(spark, {"network_feature_table": features}, out, model, "v2").select("model_version").distinct().collect()[0][0] == "v2"
    (landing / "sms-call-internet-mi-2013-11-09.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        daily.run(spark, str(landing), clean_to, out, now="2013-11-09 00:00:00", gated=True)
    failed = files.read_status(spark, f"{out}/pipeline_status").first()
    assert failed["status"] == "FAILED" and failed["failed_task"] == "ingest"


def test_strict_policies(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 00:00:00", "1", "39", "-1", None, None, None, "x"),
         (None, " null ", "39", "1", "2", "3", "4", "5")], ", ".join(f"{c} string" for c in S.RAW_COLUMNS))
    parsed = clean.parse_activity(raw)
    assert parsed.filter("internet_activity IS NULL").count() == 1
    assert clean.drop_keyless(parsed).count() == 1
    with pytest.raises(ValueError, match="1 rows"):
        clean.refuse_negatives(parsed)
    assert clean.refuse_negatives(parsed.filter("sms_in > 0")).count() == 1
    with pytest.raises(ValueError):
        clean.reject_reason("other")
    with pytest.raises(ValueError, match="geometry"):
        aggregate.geometry_free(parsed.withColumn("geometry", F.lit("")))
    with pytest.raises(ValueError):
        aggregate.hourly_grid(parsed, null_mode="other")
