"""Dense surrogate keys without a single global sort."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RANGE_BYTES = 6  # bytes of a text behind the prefix all texts share; 48 bits fit a double exactly


def number_of_ranges(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, so they grow with the cluster."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_cuts(df: DataFrame, value: Column, ranges: int) -> Column:
    """`ranges` - 1 cuts of like row counts, from a sketch, as a scalar."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return df.agg(F.percentile_approx(value, shares, 10 * ranges).alias("_c")).scalar()


def range_of(cuts: Column, value: Column) -> Column:
    """How many of the ascending cuts lie below the value: a binary search, so very many cuts cost little more than a few."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(cuts) + 1)).cast("int"), F.lit(1)))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(span, _):
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(cuts, middle) < value, F.lit(False)) & (span["lo"] < span["hi"])
        return F.struct(F.when(below, middle + 1).otherwise(span["lo"]).alias("lo"),
                        F.when(below, span["hi"]).otherwise(F.least(middle, span["hi"])).alias("hi"))

    return F.coalesce(F.aggregate(steps, start, halve)["lo"], F.lit(0))


def text_ranges(df: DataFrame, name: str) -> DataFrame:
    """Adds `_bucket`, which does not fall as the text rises: ranges of the bytes behind the common prefix.

    Least and greatest text share exactly the prefix that all share, so ids such as MI-000123 spread too.
    """
    text = F.col(name)
    edges = df.agg(F.min(text).alias("a"), F.max(text).alias("z"))
    longest = F.sequence(F.lit(1), F.least(F.octet_length("a"), F.octet_length("z")) + 1)
    a, z = F.hex(F.col("a")), F.hex(F.col("z"))
    first = F.array_min(F.filter(longest, lambda k: F.substring(a, 2 * k - 1, 2) != F.substring(z, 2 * k - 1, 2)))
    start = edges.select(F.coalesce(first, F.lit(1)).alias("k")).scalar()
    tail = F.substring(F.hex(text), 2 * F.col("_k") - 1, F.lit(2 * RANGE_BYTES))
    placed = df.withColumn("_k", start).withColumn(
        "_at", F.conv(F.rpad(tail, 2 * RANGE_BYTES, "0"), 16, 10).cast("double")).drop("_k")
    cuts = range_cuts(placed, F.col("_at"), number_of_ranges(df))
    return placed.withColumn("_cuts", cuts).withColumn("_bucket", range_of(F.col("_cuts"), F.col("_at"))).drop("_cuts", "_at")


def dense_keys(df: DataFrame, order, name: str, bucket: Column | None) -> DataFrame:
    """Adds 1..n in the order of the unique columns `order`.

    `bucket` must not fall as the order rises (a date); None: `df` has it as `_bucket` (see `text_ranges`). Rows are
    numbered inside a bucket and shifted by the size of the buckets before it; only
    the bucket sizes, one row each, pass through one task.
    """
    marked = df if bucket is None else df.withColumn("_bucket", bucket)
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return (
        marked.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_offset", "_inside")
    )
