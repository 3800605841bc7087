"""Star schema of the hourly summary and the reporting queries on it."""

from pyspark.sql import DataFrame, functions as F

from hourgrid.functions import columns as C
from hourgrid.functions.keys import dense_keys, text_ranges

# Accepted source column names, in order of preference.
ALIASES = {
    "grid": ["grid_id", "gridid", "grid"],
    "time": ["datetime", "timestamp", "hour", "time", "date_hour", "start_time"],
    "sms": ["total_sms", "sms", "sms_total", "sms_activity"],
    "calls": ["total_calls", "calls", "call", "call_total", "calls_total"],
    "internet": ["internet", "internet_traffic", "internet_total", "internet_activity"],
}
FACT_COLUMNS = [
    "time_key", "grid_key", "grid_id", "event_time",
    "sms_count", "call_count", "internet_volume",
]


def warehouse_source(summary: DataFrame) -> DataFrame:
    """Hourly summary under the warehouse names, whatever its columns are called."""
    measures = {"sms_count": "sms", "call_count": "calls", "internet_volume": "internet"}
    named = summary.select(
        C.resolve_column(summary, ALIASES["grid"]).cast("string").alias("grid_id"),
        C.resolve_column(summary, ALIASES["time"]).alias("event_time"),
        *[C.resolve_column(summary, ALIASES[a], 0.0).alias(m) for m, a in measures.items()],
    )
    return named.withColumns({
        "event_time": C.parsed_timestamp(named, "event_time"),
        **{m: F.coalesce(C.parsed_measure(named, m), F.lit(0.0)) for m in measures},
    }).withColumns({
        "date": F.to_date("event_time"),
        "hour": F.hour("event_time"),
        "day_of_week": F.date_format("event_time", "EEEE"),
    })


def dim_time(source: DataFrame) -> DataFrame:
    """Distinct hours with keys in date and hour order."""
    hours = source.select(F.col("date").alias("event_date"), "hour", "day_of_week").distinct()
    keyed = dense_keys(hours, ["event_date", "hour"], "time_key", F.col("event_date"))
    return keyed.select("time_key", "event_date", "hour", "day_of_week")


def dim_grid(source: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Distinct grids with keys in text order of the id, located where a polygon exists."""
    grids = text_ranges(source.select("grid_id").distinct(), "grid_id")
    keyed = dense_keys(grids, ["grid_id"], "grid_key", None)
    if centroids is None:
        blank = {c: F.lit(None).cast("double") for c in ("centroid_latitude", "centroid_longitude")}
        located = keyed.withColumns({**blank, "geometry_reference": F.lit(None).cast("string")})
    else:
        located = keyed.join(centroids, "grid_id", "left")
    return located.select(
        "grid_key", "grid_id", "centroid_latitude", "centroid_longitude", "geometry_reference"
    )


def fact_activity(source: DataFrame, times: DataFrame, grids: DataFrame) -> DataFrame:
    """One row per source row with both dimension keys."""
    hours = times.select("time_key", F.col("event_date").alias("date"), "hour")
    return (
        source.join(hours, ["date", "hour"])
        .join(grids.select("grid_key", "grid_id"), "grid_id")
        .select(*FACT_COLUMNS)
    )


def fact_keys(fact: DataFrame) -> DataFrame:
    """`fact_key`, unique and dense inside each hour's block of keys."""
    return dense_keys(fact, ["event_time", "grid_id"], "fact_key", F.col("time_key"))


def _grid_sums(fact, grids):
    return (
        fact.groupBy("grid_key").agg(
            F.sum("sms_count").alias("total_sms"),
            F.sum("call_count").alias("total_calls"),
            F.sum("internet_volume").alias("total_internet"),
        ).join(grids.select("grid_key", "grid_id"), "grid_key").drop("grid_key")
    )


def top_grids(fact: DataFrame, grids: DataFrame, k=10) -> DataFrame:
    """Grids by total activity; facts are summed by key before the dimension joins."""
    total = F.col("total_sms") + F.col("total_calls") + F.col("total_internet")
    return _grid_sums(fact, grids).orderBy(total.desc(), "grid_id").limit(k)


def top_internet_grids(fact: DataFrame, grids: DataFrame, k=5) -> DataFrame:
    sums = _grid_sums(fact, grids).select("grid_id", F.col("total_internet").alias("internet_volume"))
    return sums.orderBy(F.desc("internet_volume"), "grid_id").limit(k)


def hourly_trend(fact: DataFrame, times: DataFrame) -> DataFrame:
    sums = fact.groupBy("time_key").agg(
        F.sum("sms_count").alias("total_sms"),
        F.sum("call_count").alias("total_calls"),
        F.sum("internet_volume").alias("total_internet"),
    )
    return sums.join(times, "time_key").select(
        "event_date", "hour", "total_sms", "total_calls", "total_internet"
    ).orderBy("event_date", "hour")


def internet_heavy_hours(fact: DataFrame, times: DataFrame, k=10) -> DataFrame:
    return hourly_trend(fact, times).select("event_date", "hour", "total_internet").orderBy(
        F.desc("total_internet"), "event_date", "hour"
    ).limit(k)


def warehouse_checks(
    source: DataFrame, grids: DataFrame, fact: DataFrame, tolerance=1e-9
) -> DataFrame:
    """One row per check: name, passed, details. Each table is read once.

    Sums of doubles differ with the order of addition, so they are compared relative to their size.
    """
    measures = ["sms_count", "call_count", "internet_volume"]

    def profile(df):
        per_grid = df.groupBy("grid_id").agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(m) for m in measures]
        )
        return per_grid.agg(F.struct(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.count("grid_id").alias("grids"),
            *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures],
        ).alias("_p"))

    dimension = grids.groupBy("grid_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.struct(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("_n") > 1).alias("duplicates"),
    ).alias("_d")).scalar()
    base = profile(source).select(
        F.col("_p").alias("s"), profile(fact).scalar().alias("f"), dimension.alias("d")
    )

    def pair(label, a, b):
        return F.format_string(label, a.cast("string"), b.cast("string"))

    plain = "geometry" not in fact.columns and "geometry_reference" not in fact.columns
    close = [F.abs(F.col(f"s.{m}") - F.col(f"f.{m}"))
             <= tolerance * F.greatest(F.abs(F.col(f"s.{m}")), F.lit(1.0)) for m in measures]
    rows = [
        ("fact_rows_equal_source", F.col("s.rows") == F.col("f.rows"),
         pair("source=%s, fact=%s", F.col("s.rows"), F.col("f.rows"))),
        ("dim_grid_equals_distinct_grids", F.col("s.grids") == F.col("d.rows"),
         pair("source_distinct=%s, dim_grid=%s", F.col("s.grids"), F.col("d.rows"))),
        ("no_duplicate_dim_grid", F.col("d.duplicates") == 0,
         F.format_string("duplicates=%d", F.col("d.duplicates"))),
        ("fact_has_no_geometry", F.lit(plain), F.lit("geometry column absent" if plain else "geometry column present")),
        ("sums_match_source", close[0] & close[1] & close[2],
         F.format_string("tolerance=%s", F.lit(str(tolerance)))),
    ]
    listed = F.array(*[
        F.struct(F.lit(n).alias("name"), p.alias("passed"), d.alias("details")) for n, p, d in rows
    ])
    return base.select(F.explode(listed).alias("_c")).select("_c.*")
