"""The prefix trie of conversations, summed bottom-up in depth bands.

A node is a distinct sequence of first turns. Each turn becomes a 128-bit digest of its role and text; a prefix is named by the
exclusive or of the digests of its (place, turn) pairs, so that one window per conversation names all prefixes and a
parent's name follows from its child's. Nodes are one aggregate over the prefixes of all conversations.

Sums over subtrees go by bands of `BAND` depths. A node's own values are sent only to its ancestors in its band (at most
`BAND` rows a node). The nodes at the tops of the bands then form a tree of their own, `BAND` times less deep, that is
summed in the same way; the completed total of each top is sent to its ancestors in the band above, below that band's own top. Depth d
takes about 2 * log(d) / log(BAND) rounds.

All tables after the first window are narrow (names and numbers, no texts). The root and a very common first turn are summed in
the tasks before rows move; the join that gives a node its parent's smallest member is a sort-merge join of two exchanges,
which adaptive execution splits where one parent has very many children. A conversation of any length is a window of
its own, spilled when long. Only the greatest depth reaches the driver.

Cases: a null role or text is empty. Turns of equal place in a conversation go by role, then text; a repeated row is a turn of
its own. Rows without conv_id belong to no conversation. A conversation without turns is a member of the root alone. An
empty table gives no nodes. Other columns are not read. Prefixes and turns are compared by 128-bit digests.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm import storage

BAND = 8
ENDS_LOG = 12  # ids of one span of 2**12 make one string
KEY = ["depth", "k1", "k2"]


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, chars) for the turns of each conversation in order: place from 1, digest, code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", role, text)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.withColumn("at", F.row_number().over(order)).select(
        "conv_id", "at", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", F.lit(2), "role").alias("t2"),
        F.length("text").cast("long").alias("chars"))


def _prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conversation and depth: the prefix's name, its parent's, the last turn's length, and the names above.

    `turns` has conv_id, columns that sort the turns (an array `order`), t1, t2 and chars.
    """
    root = conversations.select("conv_id", F.array().cast("array<int>").alias("order"), F.lit(0).cast("long").alias("t1"),
                                F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("chars"))
    rows = root.unionByName(turns.select("conv_id", "order", "t1", "t2", "chars"))
    by = Window.partitionBy("conv_id").orderBy("order")  # the empty array, the root, comes first
    far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"depth": F.row_number().over(by) - 1, "last": F.lead(F.lit(1)).over(by).isNull()})
    at = F.col("depth")
    own = {f"g{i}": F.when(at == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(f"t{i}", at, F.lit(i))) for i in (1, 2)}
    rows = rows.withColumns(own)
    rows = rows.withColumns({f"k{i}": F.bit_xor(f"g{i}").over(far) for i in (1, 2)})
    rows = rows.withColumn("above", F.collect_list(F.struct("k1", "k2")).over(by.rowsBetween(-BAND, -1)))
    parent = {f"p{i}": F.expr(f"k{i} ^ g{i}") for i in (1, 2)}
    return rows.withColumns(parent).select("conv_id", *KEY, "p1", "p2", "chars", "last", "above")


def _sent_up(rows: DataFrame, height: Column, values: list[str]) -> DataFrame:
    """The sums of `values` over rows sent to their nearest `height` ancestors; `above` has the names, furthest first."""
    near = F.slice("above", F.size("above") - height + 1, height)
    sent = rows.filter(height > 0).select("depth", *values, F.posexplode(near).alias("i", "node"), height.alias("height"))
    return sent.select((F.col("depth") - F.col("height") + F.col("i")).alias("depth"), "node.k1", "node.k2", *values)


def _subtree_sums(prefixes: DataFrame, nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """The sums of `values` over the subtree of each node, itself included.

    `nodes` has conv_id (a conversation through the node, the same for all of its columns), KEY and `values`; `prefixes`
    has the same keys by conv_id with `above`, the names of up to BAND ancestors.
    """
    sums = [F.sum(v).alias(v) for v in values]
    placed = nodes.join(prefixes.select("conv_id", "depth", "above"), ["conv_id", "depth"])
    inside = _sent_up(placed, F.col("depth") % BAND, values)
    total = nodes.select(*KEY, *values).unionByName(inside).groupBy(*KEY).agg(*sums)
    if deepest < BAND:
        return total
    total = storage.staged(total, "trie-bands")
    tops = nodes.filter(F.col("depth") % BAND == 0).select("conv_id", *KEY).join(total, KEY)
    scaled = (F.col("depth") / BAND).cast("int").alias("depth")
    tops = storage.staged(tops.select("conv_id", scaled, "k1", "k2", *values), "trie-tops")
    by = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(-BAND, -1)
    higher = prefixes.filter(F.col("depth") % BAND == 0).select("conv_id", scaled, "k1", "k2").withColumn(
        "above", F.collect_list(F.struct("k1", "k2")).over(by))
    done = _subtree_sums(higher, tops, values, deepest // BAND)
    done = tops.select("conv_id", *KEY).join(done, KEY).withColumn("depth", F.col("depth") * BAND)
    below = done.filter("depth > 0").join(prefixes.select("conv_id", "depth", "above"), ["conv_id", "depth"])
    across = _sent_up(below, F.lit(BAND - 1), values)
    # A completed top replaces its sum within the band; the nodes between two tops add what comes from the band below.
    within = total.filter(F.col("depth") % BAND > 0)
    return within.unionByName(done.select(*KEY, *values)).unionByName(across).groupBy(*KEY).agg(*sums)


def _joined_ids(batches):
    """SHA-256 of the pieces of each node, which come sorted by node and span; one state at a time."""
    node, state = None, None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if row[:3] != node:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = row[:3], hashlib.sha256(row[3].encode())
            else:
                state.update(b"," + row[3].encode())
        yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), r, strict=True)) for r in out], schema=_ENDS)
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), (*node, state.hexdigest()), strict=True))], schema=_ENDS)


_ENDS = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def end_ids(prefixes: DataFrame) -> DataFrame:
    """The ids of the conversations that end at a node, ascending and comma-joined, a row for each node and span of ids."""
    span = F.expr(f"cast(conv_id as long) >> {ENDS_LOG}").alias("span")
    return prefixes.filter("last").groupBy(*KEY, span).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))


def end_digests(prefixes: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the nodes at which conversations end. A node's spans are hashed one after the other."""
    spans = end_ids(prefixes).repartition(storage.partitions(prefixes.sparkSession), *KEY).sortWithinPartitions(*KEY, "span")
    return spans.select(*KEY, "ids").mapInArrow(_joined_ids, "depth int, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of `turns` (conv_id, order, t1, t2, chars) and the prefixes they were made of.

    `conversations` lists every conv_id once, also those without turns. A node has its name (depth, k1, k2), conv_id (smallest
    member), parent_conv_id, n_convs, n_ends, n_children, n_leaves and saved_tokens.
    """
    prefixes = storage.staged(_prefixes(turns, conversations), "trie-prefixes")
    nodes = storage.staged(prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"),
        F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-nodes")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
    own = nodes.select("conv_id", *KEY, leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = _subtree_sums(prefixes, own, ["n_leaves", "saved_tokens"], deepest)
    up = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = up.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(sums, KEY).join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = full.withColumns({p: F.when(F.col("depth") > 0, F.col(p)) for p in ("p1", "p2")})  # the root has no parent
    return full.join(names, ["depth", "p1", "p2"], "left").select(
        *KEY, "conv_id", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens"), prefixes


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of the conversations of op11: the first h turns of conversation c - c % 100, then c's own after its first h."""
    own = storage.staged(digested(turns), "trie-turns")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = own.filter("at = 1").select("conv_id", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    digest = ["t1", "t2", "chars"]
    tails = own.filter(F.col("at") > heads).select("conv_id", F.array(F.lit(1), "at").alias("order"), *digest)
    first = own.filter("conv_id % 100 = 0 and at <= 5").select(F.col("conv_id").alias("base"), "at", *digest)
    start = convs.join(first, "base").filter("at <= h").select("conv_id", F.array(F.lit(0), "at").alias("order"), *digest)
    return start.unionByName(tails), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, conversations = rebuilt(storage.table(spark, folder, "conversations"))
    nodes, prefixes = prefix_trie(turns, conversations)
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.join(end_digests(prefixes), KEY, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                                            lambda s: CAST(ascii(s) AS BIGINT))),
                                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM ids, crc_table),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT h.conv_id, 0 AS part, place, role, text FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100 AND place <= h
  UNION ALL SELECT conv_id, 1, place, role, text FROM own JOIN heads USING (conv_id) WHERE place > h),
named AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         md5(string_agg(length(role) || ' ' || role || md5(text), ',') OVER w) AS node
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
prefixes AS (SELECT * FROM named UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
placed AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM prefixes),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) = count(*) FILTER (last) AS leaf,
         any_value(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM placed GROUP BY depth, node),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (leaf) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM (SELECT conv_id, depth, leaf, n_convs, n.chars FROM nodes n) n JOIN (SELECT conv_id, depth, node FROM placed) p
    ON p.conv_id = n.conv_id AND p.depth <= n.depth
  GROUP BY p.depth, p.node),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (depth, node) LEFT JOIN children USING (depth, node)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
"""
