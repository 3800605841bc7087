"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is the weight it should have over the size it has, times the size of the mix. Each document
draws its count from a Poisson distribution of that mean by inversion of a hash-seeded uniform value, is exploded by
the count, and the copies are sorted by a hash, which shuffles them globally: the hash is even, so its first digits name the
range of a copy, and one exchange orders all. Sizes are summed per task before they are exchanged.

Rates of sources with at least a share `LARGE` of the rows or characters, of which there can be 2 / `LARGE` at most, are broadcast; documents of
all other sources meet their rates by an exchange, in which no source is large. So no source makes a hot task, however many there are.

Means above `STEP` are drawn as sums of independent values with means up to `STEP`, which keeps the table
of the inverse short: one row per source.

Cases: a null source is a source of its own. Null text has size 0. A row without key takes the hash of all its columns for one. Repeated
rows draw the same count and keep all their copies. A source of size 0 or without target weight has rate 0. An empty table gives no rows. Columns named copy or
shuffle_key are replaced.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import storage

SEED = 20
STEP = 16.0
TAIL = 80  # terms of the inverse: beyond, the chance at mean STEP is below 1e-30
TEMPERATURE = 0.7
LARGE = 1e-3  # 2,000 rates at most are broadcast, 1.4 MB


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the first 13 hexadecimal digits of a hash; ties to no row order."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Characters (size) and rows by source."""
    return docs.groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(
        F.sum(F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("long")).alias("size"), F.count(F.lit(1)).alias("rows"))


def tempered_weights(sizes: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Target weights in proportion to size ** temperature: small sources are repeated, large ones thinned."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(temperature)).alias("weight"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = SEED,
                text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed corpus: `docs` with copy (from 1) and shuffle_key, in order of that key.

    `weights` has source and weight (any scale; default: `tempered_weights`); `total` is the size of the mix in
    characters (default: that of `docs`).
    """
    sizes = source_sizes(docs, text, source)
    weights = tempered_weights(sizes) if weights is None else weights.select(
        F.col("source").cast("string").alias("source"), F.col("weight").cast("double").alias("weight"))
    every = sizes.alias("s").join(weights.alias("w"), F.expr("s.source <=> w.source"), "left").select("s.source", "size", "rows", "weight")
    weighed = every.filter("weight is not null")
    all_weight = weighed.agg(F.sum("weight")).scalar()
    size = F.lit(total).cast("double") if total is not None else weighed.agg(F.sum("size").cast("double")).scalar()
    rate = F.coalesce(F.when(F.col("size") > 0, F.col("weight") / all_weight * size / F.col("size")), F.lit(0.0))
    share = sizes.agg(F.sum("size").cast("double").alias("size"), F.sum("rows").alias("rows"))
    large = (F.col("size") >= share.select("size").scalar() * LARGE) | (F.col("rows") >= share.select("rows").scalar() * LARGE)
    rates = every.select("source", rate.alias("rate"), large.alias("large")).withColumn(
        "draws", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")).withColumn(
        "mean", F.col("rate") / F.col("draws"))
    # Distribution function at 0, 1, 2, ...: state (k, chance of k, sums).
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(TAIL)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("sums")),
        lambda s, k: F.struct(
            (s["p"] * F.col("mean") / k).alias("p"),
            F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * F.col("mean") / k)).alias("sums")),
        lambda s: s["sums"])
    rates = storage.staged(rates.select(F.col("source").alias("rate_source"), "large", "draws", table.alias("below")), "rates")
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    draw = storage.free_name(docs, "times")
    ident = F.coalesce(F.col(f"`{key}`").cast("string"), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept]))))
    same = F.col(f"`{source}`").cast("string").eqNullSafe(F.col("rate_source"))
    sent = F.broadcast(rates.filter("large"))
    others = docs.join(sent.select("rate_source"), same, "left_anti")
    joined = docs.join(sent, same).union(others.join(rates.filter("not large").hint("shuffle_hash"), same))
    count = F.aggregate(F.sequence(F.lit(1), "draws"), F.lit(0), lambda n, j: n + F.size(
        F.filter("below", lambda c: c < uniform(F.lit(seed), ident, j))))
    counted = joined.select(*[F.col(f"`{c}`") for c in kept], count.alias(draw)).filter(F.col(draw) > 0)
    copies = counted.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(1), F.col(draw))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), ident, "copy")))
    ranges = storage.partitions(docs.sparkSession)
    digits = F.conv(F.substring("shuffle_key", 1, 7), 16, 10).cast("long")
    return keyed.repartitionById(ranges, F.shiftright(digits * ranges, 28).cast("int")).sortWithinPartitions("shuffle_key", "copy")


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(storage.table(spark, folder, "documents"))


ORACLE_SQL = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) / sum(pow(size, {TEMPERATURE})) OVER ()
                         * sum(size) OVER () / size ELSE 0 END AS rate FROM sizes),
split AS (SELECT source, greatest(ceil(rate / {STEP}), 1) AS draws, rate / greatest(ceil(rate / {STEP}), 1) AS mean FROM rates),
terms AS (SELECT source, draws, k, sum(exp(-mean + k * ln(greatest(mean, 1e-300)) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
          FROM split, range(0, {TAIL + 1}) AS t(k)),
drawn AS (SELECT doc_id, d.source, j, (CAST('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
          FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source, range(1, 10000) AS r(j) WHERE j <= draws),
counted AS (SELECT doc_id, count(*) AS n FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND below < u GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(nth AS INTEGER) AS copy, md5('order:{SEED}:' || doc_id || ':' || nth) AS shuffle_key
FROM (SELECT d.*, unnest(range(1, n + 1)) AS nth FROM documents d JOIN counted USING (doc_id))
"""
