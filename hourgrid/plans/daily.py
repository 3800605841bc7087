"""The batch job: daily files in, curated tables, warehouse, alerts and features out.

`run` makes all tables from one folder of files. From the command line, and with `gated`, the job goes day by
day instead (see `day_by_day`). Each stage is written and read back. The next stage starts from files, so a lost
executor costs at most one stage, and the hourly table is computed once for all users.

    python -m hourgrid.plans.daily --input DIR --processed DIR --analytics DIR --now TIME [--reference FILE]
"""

import argparse
import logging

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from hourgrid.operators import (
    aggregate, alerts, anomaly, gates, geo, learning, runs, series, warehouse,
)
from hourgrid.plans import day_by_day
from hourgrid.session import build_session, cut_lineage
from hourgrid.sources import files, sinks

log = logging.getLogger("hourgrid.daily")


def _stored(spark: SparkSession, df: DataFrame, path: str, time=None) -> DataFrame:
    """The frame as read back from `path`; by date of the column `time`, if one is named."""
    if time:
        df = df.withColumn("date", F.to_date(time))
        sinks.write_by_date(df, path, sort=("grid_id", time))
    else:
        sinks.write_table(df, path)
    log.info("written %s", path)
    # The schema is given, as a table without any rows by date has no file to tell it.
    return spark.read.schema(df.schema).parquet(path)


def process_files(spark: SparkSession, source, processed: str) -> tuple[DataFrame, DataFrame]:
    """Clean activity by date and the counts of the run, both as stored. `source` is a folder or a list of files.

    The columns of each file are taken by its header; a file that lacks one is an error. The text is parsed once, nulls and
    rejects are counted on the way.
    """
    headers = cut_lineage(gates.file_headers(files.read_lines(spark, source)))
    if headers.isEmpty():
        raise FileNotFoundError(f"no activity file in {source}")
    bad = gates.header_gate(headers.select("filename"), headers).filter("schema_reason <> 'SCHEMA_VALID'").first()
    if bad:
        raise ValueError(f"{bad['filename']}: {bad['schema_reason']}")
    activity, counts = day_by_day.cleaned(files.read_by_header(spark, headers))
    counted = _stored(spark, spark.createDataFrame([counts]), f"{processed}/run_counts")
    return _stored(spark, activity, f"{processed}/activity", "timestamp"), counted


def build_analytics(
    spark: SparkSession, activity: DataFrame, analytics: str, lookup: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Hourly summary, dashboard, warehouse, features, anomalies and alerts, as stored."""
    hourly = _stored(
        spark, aggregate.geometry_free(aggregate.hourly_grid(activity)),
        f"{analytics}/hourly_grid_summary", "timestamp",
    )
    tables = {"hourly_grid_summary": hourly}

    def store(name, df, time=None):
        tables[name] = _stored(spark, df, f"{analytics}/{name}", time)

    sinks.write_report(
        aggregate.dashboard_totals(hourly), f"{analytics}/dashboard_summary", single_file=True
    )
    centroids = None
    if lookup is not None:
        centroids = geo.centroids_by_box(lookup)
        store("grid_activity_geo", geo.enriched(geo.attach_geometry(hourly, lookup)), "timestamp")
    source = warehouse.warehouse_source(hourly)
    store("dim_time", warehouse.dim_time(source))
    store("dim_grid", warehouse.dim_grid(source, centroids))
    store("fact_network_activity",
          warehouse.fact_activity(source, tables["dim_time"], tables["dim_grid"]), "event_time")
    store("network_feature_table", series.feature_table(hourly), "feature_timestamp")
    store("network_anomaly_scores", anomaly.anomaly_scores(hourly), "timestamp")
    store("network_alerts", alerts.rule_alerts(hourly), "timestamp")
    return tables


def publish(
    spark: SparkSession, counted: DataFrame, tables: dict[str, DataFrame], analytics: str,
    run_id: str, now: str,
) -> DataFrame:
    """Write the run's status record after the warehouse checks."""
    source = warehouse.warehouse_source(tables["hourly_grid_summary"])
    fact = tables["fact_network_activity"]
    failed = warehouse.warehouse_checks(source, tables["dim_grid"], fact).agg(
        F.count_if(~F.col("passed")).alias("n")
    ).scalar()
    facts = fact.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("as_of"))
    ).scalar()
    counts = counted.select(
        F.col("raw_rows").alias("rows_in"), F.col("rejected_rows").alias("rows_rejected"),
        "nulls_handled", "balanced", facts.getField("n").alias("rows_published"),
        facts.getField("as_of").alias("as_of"), failed.alias("_failed"),
    )
    record = runs.publication_record(counts, {
        "processed_activity_exists": F.col("rows_in") > F.col("rows_rejected"),
        "hourly_summary_exists": F.col("rows_published") > 0,
        "row_balance": F.col("balanced"),
        "warehouse_exists": F.col("_failed") == 0,
    }, "daily activity", run_id, now)
    path = f"{analytics}/pipeline_status"
    sinks.write_status(record, path)
    return files.read_status(spark, path)


def score(spark: SparkSession, tables: dict[str, DataFrame], analytics: str, model, version: str) -> DataFrame:
    """Score the stored features and upsert them into the risk table."""
    features = learning.require_scorable(tables["network_feature_table"])
    learning.require_model_schema(model, features)
    risk = learning.risk_rows(learning.with_probability(model, features), version)
    path = f"{analytics}/network_risk_scores"
    sinks.upsert_by_date(spark, risk, path)
    return spark.read.parquet(path)


def run(spark, source, processed, analytics, reference=None, run_id="manual", now=None, gated=False,
        model=None, version="gbt-v1") -> DataFrame:
    """All stages over all files of `source`; returns the status record and raises when a check failed.

    With `gated`, the run is one of `day_by_day`: only new files that pass the gates are taken in, on top of what
    earlier runs stored. With `model`, the feature table is scored and upserted. A stage that breaks leaves a failure
    record that names it.
    """
    if gated:
        return day_by_day.run(spark, source, processed, analytics, reference, run_id, now, model, version)
    task = "spark_process"
    status = f"{analytics}/pipeline_status"
    try:
        lookup = files.read_geojson(spark, reference) if reference else None
        activity, counted = process_files(spark, source, processed)
        tables = build_analytics(spark, activity, analytics, lookup)
        if model is not None:
            task = "batch_score"
            score(spark, tables, analytics, model, version)
        task = "quality_check"
        record = publish(spark, counted, tables, analytics, run_id, now)
        row = record.first()
    except Exception as error:
        sinks.write_status(runs.failure_record(spark, "daily activity", run_id, task, str(error)[:500], str(now)), status)
        raise
    if row["status"] != "SUCCESS":
        raise RuntimeError(f"quality check failed: {row['reasons']}")
    return record


def main(argv=None):
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("input", "processed", "analytics"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--reference", help="GeoJSON file of the grid")
    parser.add_argument("--run-id", default="manual")
    parser.add_argument("--now", required=True, help="time stamp of the run")
    parser.add_argument("--model-table", help="table of a leaf-wise model, in place of --model")
    parser.add_argument("--model", help="folder of a stored classifier; features are scored with it")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = build_session("daily activity")
    model = PipelineModel.load(args.model) if args.model else None
    if args.model_table:
        model = learning.LeafwiseModel.from_table(spark.read.parquet(args.model_table))
    run(spark, args.input, args.processed, args.analytics, args.reference, args.run_id, args.now, gated=True, model=model)


if __name__ == "__main__":
    main()
