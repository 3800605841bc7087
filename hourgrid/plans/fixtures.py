"""Activity tables derived from the shared test tables, whole tables at a time.

`events` becomes raw activity: the user is the grid, the event type says which of the
five measures holds the value. Polygons are lattice cells for the keys of a table.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourgrid import schema as S
from hourgrid.functions import geometry as G
from hourgrid.operators import aggregate, alerts, anomaly, clean, geo, learning, series, warehouse
from hourgrid.session import stored, stored_by

EVENT_MEASURE = {
    "smsin": "click", "smsout": "signup", "callin": "purchase", "callout": "error",
    "internet": "view",
}
# Hourly sums are rounded so that results do not depend on the order of addition.
SCALE = 4
VERSION = "logistic-v1"
FILE_PREFIX = "sms-call-internet-mi-"


def raw_activity(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    country = F.get_json_object("props", "$.k").cast("int") % 8
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("datetime"),
        (F.col("user_id") + 1).cast("string").alias("CellID"),
        country.cast("string").alias("countrycode"),
        *[F.when(F.col("event_type") == kind, F.col("value")).alias(m)
          for m, kind in EVENT_MEASURE.items()],
    )


def corrupted_activity(raw: DataFrame) -> DataFrame:
    """The same rows, some made wrong: negative, without grid or time, or given twice."""
    n = F.col("event_id")
    broken = raw.withColumns({
        "datetime": F.when(n % 103 != 0, F.col("datetime")),
        "CellID": F.when(n % 101 != 0, F.col("CellID")),
        **{m: F.when(n % 97 == 0, -F.col(m)).otherwise(F.col(m)) for m in S.RAW_MEASURES},
    })
    copies = F.explode(F.sequence(F.lit(1), F.when(n % 107 == 0, 2).otherwise(1)))
    return broken.withColumn("_copy", copies).drop("_copy")


def polygons(keys: DataFrame, key: str) -> DataFrame:
    """Lookup (grid_id, geometry) with a lattice cell for key + 1 of every row."""
    cells = keys.select((F.col(key) + 1).cast("string").alias("grid_id")).distinct()
    return cells.withColumn("geometry", G.lattice_cell(F.col("grid_id")))


def file_rows(raw: DataFrame) -> DataFrame:
    """Raw rows as text fields of daily files; the largest values make a row faulty."""
    value = F.coalesce(*[F.col(m) for m in S.RAW_MEASURES])
    stamp = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
    return raw.select(
        F.concat(F.lit(FILE_PREFIX), F.to_date("datetime").cast("string"), F.lit(".csv"))
        .alias("filename"),
        F.lit(0).cast("bigint").alias("block"), F.col("event_id").alias("line_id"),
        F.when(value > 330, "not a time").otherwise(stamp).alias("datetime"),
        F.when(value.between(320, 330), "cell").when(value.between(310, 320), "10001")
        .otherwise(F.col("CellID")).alias("CellID"),
        F.col("countrycode"),
        *[F.when(F.col(m).between(300, 310), "abc").when(F.col(m).between(290, 300), "-1.5")
          .otherwise(F.coalesce(F.col(m).cast("string"), F.lit(""))).alias(m)
          for m in S.RAW_MEASURES],
    )


def accepted_files(raw: DataFrame) -> DataFrame:
    """Names taken before: days on which a `smsout` value above 250 occurs."""
    return raw.filter("smsout > 250").select(
        F.concat(F.lit(FILE_PREFIX), F.to_date("datetime").cast("string"), F.lit(".csv"))
        .alias("filename")
    ).distinct()


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Written answers around every conversation turn, with the numbers they may use."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    size, conv = F.length("text"), F.col("conv_id")
    user = F.col("role") == "user"
    text = F.concat(
        F.lit("SEVERITY\nEVIDENCE\n1. size "), size.cast("string"), F.lit(".25, share "),
        (conv % 100).cast("string"), F.lit("%, turn -"), (conv * 3 + 40).cast("string"),
        F.lit(".5\n"), F.col("text"), F.lit("\nINTERPRETATION\n"), F.col("text"),
        F.when(F.col("turn") == 1, F.lit("\nThis Indicates Congestion.")).otherwise(F.lit("")),
        F.when(F.col("role") == "system", F.lit("\nINSUFFICIENT EVIDENCE")).otherwise(F.lit("")),
        F.when(user, F.lit("")).otherwise(F.lit("\nNEXT CHECKS\nnone")),
    )
    score = F.when(~user, (conv % 50) / F.lit(100.0))
    return turns.select(
        "conv_id", "turn", score.alias("anomaly_score"), text.alias("response"),
        F.array(size + F.lit(0.25), score, conv * F.lit(1.0) + F.lit(0.5)).alias("evidence"),
    )


class Workspace:
    """Frames of one test folder, built on first use; nothing here runs a job.

    Queries that draw on more than one derived frame use `stored` instead, where they are built once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def stored(self):
        return StoredWorkspace(self.spark, self.folder)

    @cached_property
    def raw(self):
        return raw_activity(self.spark, self.folder)

    @cached_property
    def parsed(self):
        return clean.parse_activity(self.raw)

    @cached_property
    def corrupted(self):
        return clean.parse_activity(corrupted_activity(self.raw))

    @cached_property
    def hourly(self):
        return aggregate.hourly_grid(self.parsed, scale=SCALE)

    @cached_property
    def lookup(self):
        return polygons(self.table("customer"), "c_custkey")

    @cached_property
    def partial_lookup(self):
        return polygons(self.table("supplier"), "s_suppkey")

    @cached_property
    def source(self):
        return warehouse.warehouse_source(self.hourly)

    @cached_property
    def fact(self):
        """Fact columns without the surrogate keys, which the reports do not use."""
        return self.source.select(
            "grid_id", "event_time", "sms_count", "call_count", "internet_volume"
        )

    @cached_property
    def dim_time(self):
        return warehouse.dim_time(self.source)

    @cached_property
    def centroids(self):
        return geo.centroids_by_box(self.partial_lookup)

    @cached_property
    def dim_grid(self):
        return warehouse.dim_grid(self.source, self.centroids)

    @cached_property
    def keyed_fact(self):
        return warehouse.fact_activity(self.source, self.dim_time, self.dim_grid)

    @cached_property
    def alerts(self):
        return alerts.rule_alerts(self.hourly)

    @cached_property
    def scores(self):
        return anomaly.anomaly_scores(self.hourly)

    @cached_property
    def features(self):
        return series.feature_table(self.hourly)

    def _scored(self, rows):
        """A fixed logistic of two features stands in for the model where results are compared."""
        x = (F.col("peak_ratio") - 4.0) * 0.8 + F.col("activity_growth")
        return rows.withColumn(
            "prediction_probability", F.round(1.0 / (1.0 + F.exp(-x)), 6)
        )

    def risk_of(self, features):
        return learning.risk_rows(self._scored(features), VERSION)

    @cached_property
    def risk(self):
        return self.risk_of(self.features)

    @cached_property
    def labelled(self):
        return series.feature_table_with_label(self.hourly)

    @cached_property
    def scored(self):
        return self._scored(self.labelled)

    @cached_property
    def predictions(self):
        return learning.with_prediction(self.scored, 0.5)

    @cached_property
    def train_end(self):
        return learning.split_time(self.features).scalar()

    @cached_property
    def as_of(self):
        """Latest hour of the activity, from the raw times alone."""
        last = F.date_trunc("hour", F.max("timestamp"))
        return self.parsed.agg(last.alias("as_of")).scalar()


class StoredWorkspace(Workspace):
    """The same frames over an hourly table that is written once, laid out by grid.

    Raw events are read once. All windows and joins go by grid, so what is derived from the table needs no further
    exchange. It lies in the shared folder that the session names.
    """

    @property
    def stored(self):
        return self

    @cached_property
    def hourly(self):
        # Joins on (grid, time) may use the layout by grid.
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return stored_by(super().hourly, "hourly", "grid_id", ("timestamp",))

    @cached_property
    def dim_time(self):
        return stored(super().dim_time, "dim_time")

    @cached_property
    def dim_grid(self):
        return stored(super().dim_grid, "dim_grid")

    @cached_property
    def corrupted(self):
        return stored(super().corrupted, "corrupted")

    @cached_property
    def as_of(self):
        return self.hourly.agg(F.max("timestamp").alias("as_of")).scalar()
