"""Exact medians and percentiles that never gather an unbounded group in one task."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def leave_one_out_median(df: DataFrame, bucket, value: str, name: str) -> DataFrame:
    """Adds the median of the other rows of the bucket; NULL for a bucket of one.

    Taking a row out moves the middle by at most one place, so the answer is always
    made of the elements at the three middle ranks. Those are picked with windows
    over the bucket: one sort, no array per row, and equal values need no tie rule.
    """
    by_value = W.partitionBy(*bucket).orderBy(F.col(value))
    whole = W.partitionBy(*bucket)
    ranked = df.withColumns({
        "_r": F.row_number().over(by_value),
        "_n": F.count(F.lit(1)).over(whole),
    })
    r, n = F.col("_r"), F.col("_n")
    half = F.floor(n / 2)
    middle = ranked.withColumns({
        f"_m{i}": F.max(F.when(r == half + i, F.col(value))).over(whole) for i in range(3)
    })

    def without_self(k: int) -> Column:
        return F.when(r > half + k, F.col(f"_m{k}")).otherwise(F.col(f"_m{k + 1}"))

    median = (
        F.when(n == 1, F.lit(None).cast("double"))
        .when(n % 2 == 0, without_self(0))
        .otherwise((without_self(0) + without_self(1)) / 2)
    )
    return middle.withColumn(name, median).drop("_r", "_n", "_m0", "_m1", "_m2")


def bucket_median(df: DataFrame, bucket, value: str, name: str) -> DataFrame:
    """Adds the median of the whole bucket, the row itself included."""
    by_value = W.partitionBy(*bucket).orderBy(F.col(value))
    whole = W.partitionBy(*bucket)
    ranked = df.withColumns({
        "_r": F.row_number().over(by_value),
        "_n": F.count(F.lit(1)).over(whole),
    })
    r, n = F.col("_r"), F.col("_n")
    low = F.max(F.when(r == F.floor((n + 1) / 2), F.col(value))).over(whole)
    high = F.max(F.when(r == F.floor(n / 2) + 1, F.col(value))).over(whole)
    return (
        ranked.withColumns({"_lo": low, "_hi": high})
        .withColumn(name, (F.col("_lo") + F.col("_hi")) / 2)
        .drop("_r", "_n", "_lo", "_hi")
    )


def rolling_middle(value: str, rows: int, spec) -> Column:
    """The last `rows` values of an ordered window, sorted; see `median_of_sorted`."""
    return F.sort_array(F.collect_list(value).over(spec.rowsBetween(-(rows - 1), 0)))


def median_of_sorted(ordered: Column, rows: int) -> Column:
    """Median of a sorted array; NULL unless it holds `rows` values."""
    low, high = (rows + 1) // 2, rows // 2 + 1
    median = (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2
    return F.when(F.size(ordered) == rows, median)


ACCURACY = 100_000


def exact_percentile(df: DataFrame, value: str, share: float, name: str, accuracy: int = ACCURACY) -> DataFrame:
    """One row with the exact percentile, linear between neighbours.

    A sketch, off by at most one in `accuracy` rows, gives two values around the one asked for. Rows below them are counted; of
    those between, about eight in `accuracy`, each distinct value is one row, and only these are put in order. The cost of
    a row does not depend on the number of partitions.
    """
    values = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # The sketch counts its ranks a little differently; what lies next to the two values settles the difference.
    shares = [max(share - 4 / accuracy, 0.0), min(share + 4 / accuracy, 1.0)]
    v = F.col("_v")
    edges = values.agg(F.percentile_approx(v, shares, accuracy).alias("_e"), F.count(F.lit(1)).alias("_n")).select(
        F.struct(F.get("_e", F.lit(0)).alias("lo"), F.get("_e", F.lit(1)).alias("hi"), (F.col("_n") - 1).alias("last"))).scalar()
    marked = values.withColumn("_e", edges)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    rest = marked.agg(F.struct(
        F.count_if(v < lo).alias("below"), F.max(F.when(v < lo, v)).alias("before"), F.min(F.when(v > hi, v)).alias("after"))).scalar()
    middle = marked.filter((v >= lo) & (v <= hi)).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_e").alias("_e"))
    upto = F.sum("_c").over(W.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = middle.withColumn("_upto", upto).withColumn("_r", rest).select(
        "_v", (F.col("_upto") + F.col("_r.below")).alias("_upto"), "_r", (F.col("_e.last") * F.lit(share)).alias("_place"))
    place = F.col("_place")

    def ranked(k: Column) -> Column:
        return F.when(F.max(k <= F.col("_r.below")), F.max("_r.before")).otherwise(
            F.coalesce(F.min(F.when(F.col("_upto") >= k, v)), F.max("_r.after")))

    picked = placed.agg(ranked(F.floor(place) + 1).alias("_a"), ranked(F.ceil(place) + 1).alias("_z"), F.max(place - F.floor(place)).alias("_part"))
    return picked.select((F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_part")).alias(name))
