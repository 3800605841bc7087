"""Run records: the publication gate, task status and freshness."""

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C


def publication_record(
    counts: DataFrame, checks: dict[str, Column], pipeline: str, run_id, now
) -> DataFrame:
    """One status record from one row of counts.

    `counts` has rows_in, rows_rejected, nulls_handled, rows_published and as_of;
    `checks` are named boolean columns over it. Failed names become the reasons.
    """
    names = list(checks)
    entries = F.array(*[
        F.struct(F.lit(n).alias("key"), F.coalesce(checks[n], F.lit(False)).alias("value"))
        for n in names
    ])
    marked = counts.withColumn("_checks", entries)
    failed = F.filter("_checks", lambda e: ~e["value"])
    return marked.select(
        F.lit(pipeline).alias("pipeline"),
        F.when(F.size(failed) == 0, "SUCCESS").otherwise("FAILED").alias("status"),
        (F.size(failed) == 0).alias("healthy"),
        F.lit(run_id).alias("run_id"),
        F.date_format(F.lit(now).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss").alias("as_of"),
        F.when(F.size(failed) == 0, "PASS").otherwise("FAIL").alias("quality_check"),
        F.lit(None).cast("string").alias("failed_task"),
        F.lit(None).cast("string").alias("error"),
        *[F.col(c).cast("bigint").alias(c)
          for c in ("rows_in", "rows_rejected", "nulls_handled", "rows_published")],
        F.map_from_entries("_checks").alias("checks"),
        F.transform(failed, lambda e: e["key"]).alias("reasons"),
    )


def failure_record(spark, pipeline, run_id, failed_task, error, now) -> DataFrame:
    """The record of a run that broke: no counts, the task and its error."""
    row = (pipeline, "FAILED", False, run_id, now, now[:10], "FAIL", failed_task, error,
           None, None, None, None, None, None)
    return spark.createDataFrame([row], S.STATUS_SCHEMA)


def _upper(name: str) -> Column:
    return F.upper(F.coalesce(F.col(name), F.lit("UNKNOWN")))


def task_status() -> Column:
    """Map of task to state, from a status record."""
    checks = F.coalesce(F.col("checks"), F.create_map().cast("map<string,boolean>"))

    def has(*names):
        found = [F.coalesce(F.try_element_at(checks, F.lit(n)), F.lit(False)) for n in names]
        return F.array_contains(F.array(*found), True)

    quality = _upper("quality_check")
    evidence = {
        "spark_process": F.when(has(
            "processed_activity_exists", "hourly_summary_exists", "dashboard_summary_exists"
        ), "SUCCESS"),
        "load_warehouse": F.when(has("warehouse_exists"), "SUCCESS"),
        "quality_check": F.when(quality == "PASS", "SUCCESS").when(quality == "FAIL", "FAILED"),
    }
    all_good = (_upper("status") == "SUCCESS") & (quality == "PASS")

    def state(task):
        known = [evidence[task]] if task in evidence else []
        failed = F.when(F.col("failed_task") == task, "FAILED")
        return F.when(all_good, "SUCCESS").otherwise(F.coalesce(*known, failed, F.lit("UNKNOWN")))

    listed = F.create_map(*[x for t in S.PIPELINE_TASKS for x in (F.lit(t), state(t))])
    extra = F.when(
        ~all_good & F.col("failed_task").isNotNull() & ~F.col("failed_task").isin(S.PIPELINE_TASKS),
        F.create_map(F.col("failed_task"), F.lit("FAILED")),
    )
    return F.coalesce(F.map_concat(listed, extra), listed)


def run_status(status: DataFrame, now, latest: Column | None = None) -> DataFrame:
    """Health, reasons, counts, as-of time and freshness of each status record.

    `latest` is the newest event time of the warehouse; the record's own as-of stands in.
    """
    state, quality = _upper("status"), _upper("quality_check")
    own = F.try_to_timestamp(F.col("as_of"))
    as_of = own if latest is None else F.coalesce(latest, own)
    reasons = F.array_compact(F.array(
        F.when(state != "SUCCESS", F.concat(F.lit("Pipeline status is "), state)),
        F.when(quality != "PASS", F.concat(F.lit("Quality check status is "), quality)),
        F.when(F.col("failed_task").isNotNull(),
               F.concat(F.lit("Failed task: "), F.col("failed_task"))),
    ))
    counts = ("rows_in", "rows_rejected", "nulls_handled", "rows_published")
    return status.select(
        F.coalesce("run_id", F.lit("UNKNOWN")).alias("last_run_id"),
        F.coalesce("timestamp", F.lit("")).alias("last_run_timestamp"),
        task_status().alias("task_status"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        as_of.alias("as_of"),
        C.age_label(as_of, F.lit(now).cast("timestamp")).alias("freshness"),
        ((state == "SUCCESS") & (quality == "PASS")).alias("healthy"),
        reasons.alias("reasons"),
    )


def warehouse_health(fact: DataFrame, rejected: DataFrame, now) -> DataFrame:
    """Status, staleness, row counts and component states of the warehouse, one row."""
    reasons = rejected.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("_n")
    )
    # One entry per kind of reason, a fixed small set.
    refused = reasons.agg(F.struct(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.sort_array(F.collect_list("reject_reason")).alias("reasons"),
    )).scalar()
    moment = F.lit(now).cast("timestamp")
    base = fact.agg(F.max("event_time").alias("last_run"),
                    F.count(F.lit(1)).alias("warehouse_rows"))
    return base.withColumns({
        "status": C.health_label(F.col("last_run"), moment),
        "staleness_hours":
            (F.unix_timestamp(moment) - F.unix_timestamp("last_run")) / 3600.0,
        "rejected_rows": refused.getField("rows"),
        "rejected_reasons": refused.getField("reasons"),
    }).withColumns({
        "warehouse_state": F.when(F.col("warehouse_rows") > 0, "operational").otherwise("no_data"),
        "data_quality_state": F.when(F.col("rejected_rows") == 0, "good").otherwise("issues"),
    })


def grid_freshness(fact: DataFrame, now) -> DataFrame:
    """Latest event of each grid and how fresh it is at `now`."""
    moment = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return fact.groupBy("grid_id").agg(F.max("event_time").alias("last_event")).withColumn(
        "freshness", C.age_label(F.col("last_event"), moment)
    )
