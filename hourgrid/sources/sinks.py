"""Writing tables, reports, audit rows and keyed updates."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from hourgrid import schema as S
from hourgrid.operators.aggregate import duplicate_keys
from hourgrid.session import cut_lineage


def write_by_date(df: DataFrame, path: str, sort=("grid_id", "timestamp"), mode="overwrite") -> None:
    """Parquet partitioned by date, rows of a file sorted so that row groups can be skipped.

    The rebalance hint gathers a date's rows and splits dates that are large, instead of
    sending each date to one task. Only the dates present are replaced.
    """
    laid_out = df.hint("rebalance", "date").sortWithinPartitions("date", *sort)
    laid_out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
        "date"
    ).parquet(path)


def write_table(df: DataFrame, path: str, mode="overwrite") -> None:
    df.write.mode(mode).parquet(path)


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_report(df: DataFrame, path: str, single_file=False) -> None:
    """CSV with a header. `single_file` is for results of proven small size only,
    such as a top-k list or one row per date."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def export_summaries(hourly: DataFrame, daily: DataFrame, grids: DataFrame, folder: str) -> None:
    """Daily, grid and grid-hour summaries as CSV; refuses repeated grid hours."""
    if duplicate_keys(hourly).limit(1).count():
        raise ValueError("repeated (grid_id, timestamp) in the hourly summary")
    write_report(daily.orderBy("date"), f"{folder}/daily_summary", single_file=True)
    write_report(grids, f"{folder}/grid_summary")
    columns = [c for c in S.HOURLY_COLUMNS if c in hourly.columns]
    write_report(hourly.select(*columns).orderBy(*S.KEYS), f"{folder}/grid_hour_summary")


def append_audit(routed: DataFrame, path: str, processed_at) -> None:
    """One row per file seen, added to the log."""
    stamped = routed.withColumn("processed_at", F.lit(processed_at).cast("timestamp"))
    stamped.select(*S.AUDIT_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def write_status(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def merge_scores(old: DataFrame, new: DataFrame, keys=S.KEYS) -> DataFrame:
    """Old rows whose key is not in `new`, and all of `new`."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def upsert_by_date(spark: SparkSession, new: DataFrame, path: str, keys=S.KEYS) -> None:
    """Insert or replace rows of a Parquet table partitioned by the date of `timestamp`.

    Only the dates that `new` touches are read and rewritten. The merged rows are cut
    from their sources in the shared folder first, so no plan overwrites what it reads. The keys
    are a primary key: NULL and repeated keys in `new` are refused before anything is written.
    """
    dated = new.withColumn("date", F.to_date("timestamp"))
    missing = F.col("date").isNull()
    for key in keys:
        missing |= F.col(key).isNull()
    if dated.filter(missing).limit(1).count():
        raise ValueError(f"NULL in the keys {list(keys)} of new rows")
    if dated.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"repeated keys {list(keys)} in new rows")
    # Calendar days: a list this short may pass through the driver.
    touched = [r["date"] for r in dated.select("date").distinct().collect()]
    if not touched:
        return
    try:
        table = spark.read.schema(dated.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], dated.schema)
    old = table.filter(F.col("date").isin(touched)).select(*dated.columns)
    write_by_date(cut_lineage(merge_scores(old, dated, keys)), path, sort=keys)


def round_trip_check(written: DataFrame, path: str) -> DataFrame:
    """Rows and column types of a frame against the table it was written to."""
    back = written.sparkSession.read.parquet(path)
    types = {f.name: f.dataType for f in written.schema}
    same = types == {f.name: f.dataType for f in back.schema}
    return back.agg(F.count(F.lit(1)).alias("rows_read")).withColumns({
        "rows_written": written.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "same_schema": F.lit(same),
    }).withColumn("passed", (F.col("rows_read") == F.col("rows_written")) & F.col("same_schema"))
