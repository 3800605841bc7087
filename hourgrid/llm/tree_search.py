"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most about `SAMPLE_ROWS` distinct vectors chosen by hash; every vector is indexed. Equal vectors are one entry
of the index with their `k + 1` smallest ids, which is all that ties can ask for, and equal queries are asked once. A query
walks the tree with a priority queue: the bin whose centre and radius allow the largest inner product comes first. How
many leaves are visited is calibrated: up to `PROBES` queries, chosen by hash, are compared with all vectors, and the
visits grow until `RECALL` of their true neighbours lie in visited leaves.

Leaves are cut into blocks of about `BLOCK_ROWS` entries, so that neither a hot leaf nor a hot vector makes a large
task; a visit goes to every block of its leaf, and each block returns the best `k` entries of a query.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; nor do rows with a null id. Repeated rows with one id count once. Fewer candidates than `k` are all returned.
Ties go to the smaller id. An empty table gives no rows. Other columns are not read.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm import storage

NEIGHBOURS, EVERY = 20, 20
SAMPLE_ROWS = 20_000
BRANCHES, LEAF_ROWS = 8, 64
PROBES, RECALL = 200, 0.97
BLOCK_ROWS = 2048
HELD_QUERIES = 20_000


@dataclass
class Node:
    centre: np.ndarray
    radius: float = 0.0
    leaf: int = -1
    children: list = field(default_factory=list)


def k_means(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """The cluster of each row; some clusters may be empty."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        for c in range(k):
            if (at == c).any():
                centres[c] = x[at == c].mean(axis=0)
    return (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


class Tree:
    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 8):
        self.leaves = 0
        self.root = self._grow(x, leaf_rows, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, leaf_rows: int, rng) -> Node:
        centre = x.mean(axis=0)
        node = Node(centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())))
        at = k_means(x, BRANCHES, rng) if len(x) > leaf_rows else np.zeros(len(x), dtype=int)
        parts = np.unique(at)
        if len(parts) < 2:
            node.leaf = self.leaves
            self.leaves += 1
        else:
            node.children = [self._grow(x[at == c], leaf_rows, rng) for c in parts]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every level the nearest centre."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not node.children:
                out[rows] = node.leaf
                continue
            centres = np.stack([c.centre for c in node.children])
            at = (x[rows] @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
            todo += [(c, rows[at == i]) for i, c in enumerate(node.children) if (at == i).any()]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: by the largest inner product that centre and radius allow."""
        length = float(np.sqrt(q @ q))
        heap = [(0.0, 0, self.root)]
        pushed = 1
        while heap:
            _, _, node = heapq.heappop(heap)
            if not node.children:
                yield node.leaf
                continue
            for c in node.children:
                heapq.heappush(heap, (-(float(q @ c.centre) + self.slack * length * c.radius), pushed, c))
                pushed += 1

    slack = 0.35  # share of the radius that counts: the full radius is far from tight in many dimensions


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors give equal scores."""
    return (x * q).sum(axis=-1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                       & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
                       & F.exists(v, lambda c: c != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(entry, v, ids): each distinct vector with its `k` smallest ids.

    The ids are thinned in small random parts first, so no group of copies is gathered whole.
    """
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k)
    split = rows.withColumn("part", F.pmod(F.col("id"), F.lit(256)) * 256 + F.pmod(F.xxhash64("id"), F.lit(256)))
    once = split.groupBy("v", "part").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k).alias("ids"))
    twice = once.groupBy("v", F.floor(F.col("part") / 256).alias("part")).agg(few.alias("ids"))
    return twice.groupBy("v").agg(few.alias("ids")).select(F.element_at("ids", 1).alias("entry"), "v", "ids")


def _deal(shared):
    def deal(batches):
        tree = shared.value
        for batch in batches:
            leaf = tree.assign(matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    return deal


def _probe(shared):
    """The best of the partition for each probe, with leaf and place of that leaf in the probe's walk."""

    def probe(batches):
        probes, places, k = shared.value
        held = [[] for _ in probes]
        for batch in batches:
            x, leaf = matrix(batch.column("v")), batch.column("leaf").to_numpy()
            copies = pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            for i, scores in enumerate(probes @ x.T):
                top = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
                held[i] = sorted([*held[i], *zip((-scores[top]).tolist(), places[i][leaf[top]].tolist(),
                                                 copies[top].tolist(), strict=True)])[:k]
        rows = [(i, -s, int(p), int(c)) for i, best in enumerate(held) for s, p, c in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int32(), pa.int32()))],
            names=["probe", "score", "place", "copies"])

    return probe


def calibrated_visits(tree: Tree, entries: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> int:
    """Leaves to visit so that `recall` of the probes' true neighbours are found; probes see all vectors."""
    spark = entries.sparkSession
    share = min(PROBES / max(queries.count(), 1), 1.0)
    rows = queries.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").collect()
    if not rows:
        return tree.leaves
    probes = np.array(sorted(r.v for r in rows))
    places = np.empty((len(probes), tree.leaves), dtype=np.int32)
    for i, q in enumerate(probes):
        places[i, list(tree.visits(q))] = np.arange(tree.leaves)
    found = entries.mapInArrow(_probe(spark.sparkContext.broadcast((probes, places, k))),
                               "probe int, score double, place int, copies int")
    # Of the best of all partitions the best `k` of each probe reach the driver.
    first = Window.partitionBy("probe").orderBy(F.desc("score"), "place", "copies")
    found = found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).drop("nth").toPandas()
    found = found.sort_values(["probe", "score"], ascending=[True, False])
    needed = []
    for _, g in found.groupby("probe"):
        before = g["copies"].cumsum().to_numpy() - g["copies"].to_numpy()
        for place, n in zip(g["place"], np.clip(k - before, 0, g["copies"].to_numpy()), strict=True):
            needed += [place + 1] * int(n)
    needed.sort()
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) if needed else tree.leaves


def _walk(shared, visits: int):
    """(query, v, leaf) for each leaf a query visits."""

    def walk(batches):
        tree = shared.value
        for batch in batches:
            x = matrix(batch.column("v"))
            rows, leaves = [], []
            for i, q in enumerate(x):
                for _, leaf in zip(range(visits), tree.visits(q), strict=False):
                    rows.append(i)
                    leaves.append(leaf)
            taken = batch.select(["entry", "v"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, pa.int32())], names=["query", "v", "leaf"])

    return walk


def _best_of_blocks(k: int):
    """The best `k` entries of each query in the blocks of a task; rows come sorted by block, entries before queries.

    A query meets many blocks of a task, so its best are merged here for up to `HELD_QUERIES` queries at a time.
    """

    def best(batches):
        block, entries, x, waiting = None, [], None, []
        held: dict[int, list] = {}

        def flush():
            nonlocal waiting, x
            if waiting and entries:
                if x is None:
                    x = np.array([v for _, v in entries])
                names = np.array([e for e, _ in entries])
                q = np.array([v for _, v in waiting])
                scores = q @ x.T
                for (name, v), s in zip(waiting, scores, strict=True):
                    # A few more than k, then exact scores in a fixed order of summation.
                    top = np.argpartition(-s, k + 8)[:k + 8] if len(s) > k + 8 else np.arange(len(s))
                    exact = products(x[top], v)
                    mine = held.setdefault(name, [])
                    mine += zip((-exact).tolist(), names[top].tolist(), strict=True)
                    if len(mine) > 8 * k:
                        mine.sort()
                        del mine[k:]
            waiting = []

        def emit():
            rows = [(q, e, -s) for q, mine in held.items() for s, e in sorted(mine)[:k]]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query", "entry", "score"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("block", "query", "id")]
            vectors = matrix(batch.column("v"))
            for i, (at, query, name) in enumerate(zip(*columns, strict=True)):
                if at != block:
                    flush()
                    block, entries, x = at, [], None
                if query:
                    waiting.append((name, vectors[i]))
                    if len(waiting) >= 512:
                        flush()
                else:
                    entries.append((name, vectors[i]))
            if len(held) > HELD_QUERIES:
                yield emit()
        flush()
        yield emit()

    return best


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows of `vectors` found for each row of `queries`, but itself.

    `queries` are rows with the same columns.
    """
    spark = storage.bounded_batches(vectors).sparkSession
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    entries = storage.staged(distinct_vectors(rows, k + 1), "entries")
    total = entries.count()
    share = min(SAMPLE_ROWS / max(total, 1), 1.0)
    sample = entries.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").collect()
    x = np.array(sorted(r.v for r in sample))  # in an order of its own: the tree does not depend on how rows lie in files
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(x)
    shared = spark.sparkContext.broadcast(tree)
    fields = entries.schema
    dealt = storage.staged(entries.mapInArrow(_deal(shared), fields.simpleString()[7:-1] + ", leaf int"), "dealt")
    once = storage.staged(asked.groupBy("v").agg(F.min("id").alias("entry")), "queries")
    visits = calibrated_visits(tree, dealt, once, k, recall)
    # Blocks of a leaf, by hash.
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = dealt.join(F.broadcast(sizes), "leaf").select(  # a row for each leaf of the tree at most
        F.struct("leaf", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int").alias("b")).alias("at"),
        F.lit(False).alias("query"), F.col("entry").alias("id"), "v")
    walked = once.repartition(storage.partitions(spark), "entry").mapInArrow(
        _walk(shared, visits), "query long, v array<double>, leaf int")
    visited = walked.join(F.broadcast(sizes), "leaf").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visited = visited.select(F.struct("leaf", "b").alias("at"), F.lit(True).alias("query"), F.col("query").alias("id"), "v")
    both = placed.union(visited).withColumn("block", F.xxhash64("at")).drop("at")
    both = both.repartition(storage.partitions(spark), "block").sortWithinPartitions("block", "query")
    found = both.mapInArrow(_best_of_blocks(k + 1), "query long, entry long, score double")
    # The k + 1 best entries of each distinct query; each entry has at most k + 1 ids.
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "entry")))
    best = found.groupBy("query").agg(F.slice(pairs, 1, k + 1).alias("p")).select("query", F.explode("p").alias("p"))
    listed = best.select("query", "p.s", F.col("p.entry").alias("entry")).join(dealt.select("entry", "ids"), "entry")
    hits = F.slice(F.array_sort(F.flatten(F.collect_list(
        F.transform("ids", lambda i: F.struct(F.col("s").alias("s"), i.alias("id")))))), 1, k + 1)
    answers = listed.groupBy("query").agg(hits.alias("hits"))
    members = asked.select("id", "v").distinct().join(once, "v").select("id", F.col("entry").alias("query"))
    own = members.join(answers, "query").select(F.col("id").alias("query_id"), F.slice(F.filter(
        "hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    return own.select("query_id", F.posexplode("hits")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def op8_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = storage.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
