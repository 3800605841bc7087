"""The batch operators on streams: hourly sums, alerts against stored baselines, scores.

The reference design names these workloads without building them; here they reuse the
batch expressions and add only watermarks and sinks.
"""

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from hourgrid import schema as S
from hourgrid.functions import columns as C
from hourgrid.operators import alerts
from hourgrid.operators.anomaly import anomaly_direction
from hourgrid.operators.learning import risk_rows, with_probability
from hourgrid.session import stored
from hourgrid.sources.snapshots import Store
from hourgrid.sources.sinks import upsert_by_date

X = "total_activity"


def hourly_stream(activity: DataFrame, late="2 hours", scale=None) -> DataFrame:
    """Hourly sums per grid of a stream of parsed activity; later rows than `late` are dropped."""
    return _hour_windows(activity, late, scale).drop("window")


def _hour_windows(activity: DataFrame, late, scale) -> DataFrame:
    """Hourly sums that keep their window, so that further windows can follow."""
    hour = F.window("timestamp", "1 hour")
    sums = activity.withWatermark("timestamp", late).groupBy(hour, "grid_id").agg(*[
        C.rounded(F.sum(F.coalesce(F.col(m), F.lit(0.0))), scale).alias(m) for m in S.MEASURES
    ])
    return sums.select("window", "grid_id", F.col("window.start").alias("timestamp"), *S.MEASURES).withColumns(
        C.total_columns(scale)
    )


def finished_days(activity: DataFrame, late="2 hours", scale=None) -> DataFrame:
    """The hours (times and x, in order) of each grid's day, as soon as the watermark has passed it; in append mode.

    Rows are summed to hours in one watermarked aggregate and hours to days in a second one (a day has at most 24).
    """
    hours = _hour_windows(activity, late, scale)
    days = hours.groupBy(F.window(F.window_time("window"), "1 day").alias("day"), "grid_id").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", X))).alias("hours"))
    return days.select("grid_id", F.col("hours.timestamp").alias("times"), F.col(f"hours.{X}").alias("x"))


LAST = "last_activity"  # the activity of each grid's last hour so far, one row a grid


def rule_alert_stream(days: DataFrame, floor: float, store: Store, table: str, checkpoint: str):
    """A writer that adds the rule alerts of finished days to a table of a store.

    Together they are `alerts.rule_alerts(hourly, floor)` over the rows that were not dropped as late; the floor is that of stored
    history. What a day needs from before it, the grid's last activity, lies in the same store and moves with the same commit, so
    a batch that runs again neither repeats alerts nor sees its own state.
    """
    def add(batch: DataFrame, number):
        token = f"{checkpoint}#{number}"
        rows = stored(batch, "days")
        if rows.isEmpty() or store.holds_token(token):
            return
        by_time = W.partitionBy("grid_id").orderBy("_start")
        rows = rows.withColumns({"_start": F.get("times", F.lit(0)), "_end": F.element_at("x", -1)})
        linked = rows.withColumn("_before", F.lag("_end").over(by_time))
        known = store.read(LAST, T.StructType([T.StructField("grid_id", T.StringType()), T.StructField("last", T.DoubleType())]))
        linked = linked.join(known, "grid_id", "left").withColumn("before", F.coalesce("_before", "last"))
        change = store.begin()
        change.add(table, alerts.fired_rules(_scored_days(linked, floor)).withColumn("date", F.to_date("timestamp")), sort=S.KEYS)
        ends = rows.groupBy("grid_id").agg(F.max_by("_end", "_start").alias("last"))
        change.replace_whole(LAST, known.join(ends, "grid_id", "left_anti").unionByName(ends))
        change.commit(token=token)

    return days.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def _scored_days(days: DataFrame, floor: float) -> DataFrame:
    """One row for each hour of a day (arrays times and x, in order; before) with what the rules compare."""
    ordered, n = F.array_sort("x"), F.size("x")
    half = F.floor(n / 2).cast("int")
    at = F.array_position("_sorted", F.col(X)).cast("int")

    def without_self(k: int):
        place = half + k
        return F.try_element_at("_sorted", F.when(at > place, F.when(place > 0, place)).otherwise(place + 1))

    baseline = F.when(n == 1, F.lit(None).cast("double")).when(n % 2 == 0, without_self(0)).otherwise(
        (without_self(0) + without_self(1)) / 2)
    total = F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), alerts.DAY_SCALE)
    rows = days.withColumns({"_sorted": ordered, "above_activity_floor": total >= floor, "_prior": F.concat(F.array("before"), "x")})
    rows = rows.select("*", F.posexplode(F.arrays_zip("times", "x")).alias("_i", "_hour"))
    rows = rows.withColumns({"timestamp": F.col("_hour.times"), X: F.col("_hour.x"), "previous_activity": F.get("_prior", F.col("_i"))})
    return rows.select(*S.KEYS, X, "previous_activity", baseline.alias("baseline_activity"), "above_activity_floor")


def hour_baselines(hourly: DataFrame) -> DataFrame:
    """Static table for the stream: median activity per grid and hour of day."""
    return hourly.groupBy("grid_id", F.hour("timestamp").alias("hour_of_day")).agg(
        # One value per day of history in a group.
        F.median("total_activity").alias("baseline_activity")
    )


def alert_stream(hourly: DataFrame, baselines: DataFrame) -> DataFrame:
    """Hours outside the normal range of their grid and hour of day."""
    joined = hourly.withColumn("hour_of_day", F.hour("timestamp")).join(
        baselines, ["grid_id", "hour_of_day"]
    )
    base = F.col("baseline_activity")
    score = F.when(base > 0, (F.col("total_activity") - base) / base)
    return joined.withColumn("anomaly_score", score).withColumn(
        "anomaly_direction", anomaly_direction(F.col("anomaly_score"))
    ).filter("anomaly_direction <> 'NORMAL'")


def score_stream(features: DataFrame, model, path: str, version: str, checkpoint: str):
    """A writer that scores each batch of feature rows and upserts it into the risk table.

    The upsert replaces by key, so a batch that is run again leaves the same table.
    """
    def store(batch: DataFrame, _):
        upsert_by_date(batch.sparkSession, risk_rows(with_probability(model, batch), version), path)

    return features.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def added_score_stream(features: DataFrame, model, store: Store, table: str, version: str, checkpoint: str, fold_every: int = 0):
    """A writer that scores each batch of feature rows and adds the scores to a table of a store.

    What is written is the batch's rows, whatever dates they touch; `Store.newest` reads the newest of each key. A batch is
    committed under its number, so one that is run again is not added twice. With `fold_every`, every so many
    batches the dates with several parts are folded and the log is shortened.
    """
    def add(batch: DataFrame, number):
        token = f"{checkpoint}#{number}"
        if store.holds_token(token):
            return
        change = store.begin()
        rows = risk_rows(with_probability(model, batch), version)
        change.add(table, rows.withColumn("date", F.to_date("timestamp")), sort=S.KEYS)
        change.commit(token=token)
        if fold_every and number % fold_every == fold_every - 1:
            store.compact(table, S.KEYS)
            store.shorten_log()

    return features.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
