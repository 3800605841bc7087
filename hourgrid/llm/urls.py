"""URL filters as a sort-merge range join.

A host is written in reverse with a closing dot (`com.example.www.`). A rule for a host and its subdomains
is then the interval of keys that begin with the rule's key; intervals nest or are disjoint. Pages and rules are dealt to
ranges of (key, path, page) cut by a bounded sample, so a host with a third of all pages spreads over many ranges; a
rule goes to every range its interval touches. A task sweeps its sorted rows and keeps the stack of active rules.

Cases: null or no `://` gives an empty host and path, which no rule fits. Null page ids stay. Repeated pages each get
their row. Of rules with equal host and path, block wins. Rules without host or path are ignored. An empty rule table
leaves every page to the default. Columns of the page table with clashing names are replaced by the results.
"""

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import storage

DEFAULT = "allow"
SAMPLE_ROWS = 5_000
LAST = "\U0010ffff"
# The rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _split_points(keyed: DataFrame, parts: int) -> list[tuple]:
    """Cuts of the pages into even ranges, from a hash sample of about `SAMPLE_ROWS` keys."""
    share = SAMPLE_ROWS / max(keyed.count(), 1)
    chosen = F.pmod(F.xxhash64("spread"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))
    sample = keyed.select("key", "path", "spread").filter(chosen).collect()
    keys = sorted((r.key, r.path, r.spread) for r in sample)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _deal_pages(points: list[tuple]):
    def deal(batches):
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("key", "path", "spread")), strict=True)
            part = pa.array([bisect_right(points, row) for row in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    return deal


def _deal_rules(points: list[tuple]):
    def deal(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lo = bisect_left(points, (row["key"],))
                hi = bisect_left(points, (row["key"] + LAST,))
                out += [row | {"part": p} for p in range(lo, hi + 1)]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema.append(pa.field("part", pa.int32())))

    return deal


def _sweep(default: str):
    def sweep(batches):
        part, stack = None, []  # of (key, path -> (verdict, shown), path lengths), outermost first
        for batch in batches:
            rules, verdicts = [], []
            pages = []
            columns = [batch.column(n).to_pylist() for n in ("part", "key", "path", "shown", "verdict")]
            for i, (at, key, path, shown, verdict) in enumerate(zip(*columns, strict=True)):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    known, lengths = stack[-1][1:]
                    if path not in known or verdict == "block":
                        known[path] = (verdict, shown)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for level, known, lengths in stack:
                    for n in lengths:
                        hit = known.get(path[:n]) if n <= len(path) else None
                        if hit:
                            if best is None or len(level) + n >= best[0]:
                                best = (len(level) + n, hit)
                            break
                pages.append(i)
                rules.append(best[1][1] if best else None)
                verdicts.append(best[1][0] if best else default)
            kept = batch.select(["row", "host", "path"]).take(pa.array(pages, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["row", "host", "path", "rule", "verdict"])

    return sweep


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """`pages` with host, path, rule (host and path of the longest fitting rule, or null) and verdict.

    `rules` has verdict, host and path. The longest rule is the one with most characters in host and path.
    """
    spark = storage.bounded_batches(pages).sparkSession
    parts = 4 * storage.partitions(spark)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(f"`{url}`"))
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", reversed_host(F.col("host"))).withColumn(
        "spread", F.hex(F.xxhash64(F.monotonically_increasing_id())))
    points = _split_points(keyed, parts)
    none = F.lit(None).cast("string")
    wanted = ["part", "key", "path", "spread", "row", "host", "shown", "verdict"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    dealt = keyed.mapInArrow(_deal_pages(points), schema + ", part int")
    dealt = dealt.select(*[c for c in wanted if c not in ("shown", "verdict")], none.alias("shown"), none.alias("verdict"))
    low = lower_ascii(F.col("host"))
    ruled = rules.filter("host <> '' and path is not null and verdict is not null").select(
        reversed_host(low).alias("key"), F.col("path").cast("string").alias("path"),
        F.concat(low, "path").alias("shown"), F.col("verdict").cast("string").alias("verdict"))
    ruled = ruled.mapInArrow(_deal_rules(points), "key string, path string, shown string, verdict string, part int")
    ruled = ruled.select("part", "key", "path", F.lit("").alias("spread"),
                         F.lit(None).cast(keyed.schema["row"].dataType).alias("row"),
                         none.alias("host"), "shown", "verdict")
    rows = dealt.unionByName(ruled).withColumn("page", F.col("verdict").isNull())
    rows = rows.repartition(storage.partitions(spark), "part").sortWithinPartitions("part", "key", "page", "path", "spread")
    out = f"row {keyed.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return rows.mapInArrow(_sweep(default), out).select("row.*", "host", "path", "rule", "verdict")


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(storage.table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT arg_max(verdict, length(h || p)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""
