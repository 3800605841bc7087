"""Boosted trees grown leaf by leaf from histograms, with the model as a table.

Features become integer bins by cuts from one sketch. A tree grows best first: of all leaves the one whose split gains most
is split next, to any depth, until `leaves` are reached. What a round of growing needs of the rows is one aggregate:
gradient, hessian and row sums by (node, feature, bin). Only these sums move, at most nodes x features x bins of them,
and only they come to the driver, which picks the splits. A round asks for all nodes that best-first growing would
split by what is known so far, for the smaller child of each; its sibling is what the parent has beyond it. So a tree takes
about as many rounds as it is deep, not one per leaf, and is still the best-first tree.

Gradients are rounded to 2**-24 and summed as integers: sums do not depend on the order of rows or files, and neither does the model.

Cases: a null value goes left at every split, NaN right. Rows without a label are left out. Without rows, or with one class
only, the model is the constant that the labels give. A tree that finds no split is one leaf. Rows with equal bins are drawn
together where rows are sampled.
"""

import heapq
import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourgrid import schema as S
from hourgrid.functions.keys import range_of
from hourgrid.session import cut_lineage

# The trainer's settings and its defaults for leaf size, hessian and bins.
TREES, RATE, LEAVES, BINS = 300, 0.05, 31, 255
SAMPLING, SEED = 0.8, 42
MIN_ROWS, MIN_HESSIAN = 20, 1e-3

UNIT = float(1 << 24)  # gradients per row are at most 1, so 2**39 rows fit a bigint sum
MIN_GAIN = 1e-9
EDGE = 1e-15  # keeps the start score finite where a class is missing
ACCURACY = 100_000
CUT_EVERY = 10  # trees between two checkpoints of the scores
MODEL_SCHEMA = ("tree int, node bigint, feature string, threshold double, gain double, rows bigint, value double, "
                "inputs array<string>")


@dataclass
class Node:
    """A node with its sums by feature, bin and (gradient, hessian, rows); children are 2n and 2n + 1."""

    sums: np.ndarray
    gain: float = -1.0
    feature: int = -1
    bin: int = -1
    left_rows: int = 0


@dataclass
class LeafwiseModel:
    """Start score and trees; a tree is its rows of the model table by node."""

    inputs: list[str]
    start: float
    trees: list[dict[int, dict]] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node: splits have feature, threshold and gain, leaves a value. Tree 0 is the start score."""
        rows = [(0, 1, None, None, None, None, self.start, self.inputs)]
        for t, tree in enumerate(self.trees, 1):
            rows += [(t, n, r.get("feature"), r.get("threshold"), r.get("gain"), r["rows"], r.get("value"), None)
                     for n, r in sorted(tree.items())]
        return spark.createDataFrame(rows, MODEL_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> "LeafwiseModel":
        """The model of a stored table; its size is trees times leaves, not that of any data."""
        rows = table.orderBy("tree", "node").collect()
        model = LeafwiseModel(list(rows[0]["inputs"]), rows[0]["value"], [{} for _ in range(rows[-1]["tree"])])
        for r in rows[1:]:
            held = ("rows", "value") if r["feature"] is None else ("rows", "feature", "threshold", "gain")
            model.trees[r["tree"] - 1][r["node"]] = {k: r[k] for k in held}
        return model

    def score(self) -> Column:
        """Log odds, in built-in expressions."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + F.expr(tree_sql(tree))
        return total

    def with_probability(self, rows: DataFrame, name: str = "prediction_probability") -> DataFrame:
        return rows.withColumn(name, logistic(self.score()))

    def importance(self, spark: SparkSession) -> DataFrame:
        """Splits per input, most first."""
        used = [r["feature"] for tree in self.trees for r in tree.values() if "feature" in r]
        rows = [(n, float(used.count(n))) for n in self.inputs]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def raw_test(row: dict) -> str:
    return f"`{row['feature']}` > {row['threshold']!r}D"


def binned_test(row: dict) -> str:
    return f"_bins[{row['at']}] > {row['bin']}"


def leaf_value(node: int, row: dict) -> str:
    return f"{row['value']!r}D"


def tree_sql(tree: dict[int, dict], leaf=leaf_value, test=raw_test, node: int = 1) -> str:
    """Nested cases from the top; `leaf` and `test` give the text of a leaf and of what sends a row right."""
    row = tree[node]
    if "feature" not in row:
        return leaf(node, row)
    left, right = (tree_sql(tree, leaf, test, 2 * node + k) for k in (0, 1))
    return f"CASE WHEN {test(row)} THEN {right} ELSE {left} END"


def bin_cuts(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Ascending cuts by feature, at most `bins` - 1, at equal shares of the rows; one sketch each, in one pass."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{n}`").cast("double"), shares, ACCURACY).alias(f"c{i}")
                       for i, n in enumerate(names)]).first()
    return [list(c or []) for c in found]


def _best(node: Node, used: list[int], min_rows: int, min_hessian: float) -> Node:
    """Sets the best split of a node: most gain, then first feature, then lowest bin."""
    left = node.sums[used].cumsum(axis=1)
    all_ = left[:, -1:, :]
    right = all_ - left
    (gl, hl, nl), (gr, hr, nr), (g, h, _) = (np.moveaxis(x, 2, 0) for x in (left, right, all_))
    gl, hl, gr, hr, g, h = (x / UNIT for x in (gl, hl, gr, hr, g, h))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / hl + gr * gr / hr - g * g / h
    fits = (nl >= min_rows) & (nr >= min_rows) & (hl >= min_hessian) & (hr >= min_hessian) & (gain > MIN_GAIN)
    gain = np.where(fits, gain, -1.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] > 0:
        node.gain, node.feature, node.bin, node.left_rows = float(gain[f, b]), used[f], int(b), int(nl[f, b])
    return node


def _grown(nodes: dict[int, Node], leaves: int) -> tuple[list[int], list[int]]:
    """(splits in best-first order, those whose children are unknown), by what is known."""
    waiting, splits, unknown = [(-nodes[1].gain, 1)], [], []
    while waiting and len(splits) < leaves - 1:
        gain, n = heapq.heappop(waiting)
        if gain >= 0:
            break
        splits.append(n)
        if 2 * n in nodes:
            for child in (2 * n, 2 * n + 1):
                heapq.heappush(waiting, (-nodes[child].gain, child))
        else:
            unknown.append(n)
    if len(splits) == leaves - 1 and unknown == splits[-1:]:
        unknown = []  # what lies below the last split is never asked for
    return splits, unknown


def _sums(rows: DataFrame, where: str | None, features: int, bins: int) -> dict[int, np.ndarray]:
    """Sums by node of `where`, which is null for rows that nobody asks for; partial sums are made before the exchange."""
    placed = rows.withColumn("_node", F.expr(where or "1L")).filter(F.col("_node").isNotNull())
    counted = placed.select("_node", "_g", "_h", F.posexplode("_bins").alias("_feature", "_bin")).groupBy(
        "_node", "_feature", "_bin").agg(F.sum("_g"), F.sum("_h"), F.count(F.lit(1)))
    table = counted.toArrow()  # at most leaves x features x bins rows
    node, f, b, *sums = (c.to_numpy() for c in table.columns)
    found: dict[int, np.ndarray] = {}
    for n in np.unique(node).tolist():
        at = node == n
        found[n] = np.zeros((features, bins, 3), dtype=np.int64)
        found[n][f[at], b[at]] = np.stack([x[at] for x in sums], axis=1)
    return found


def grow_tree(rows: DataFrame, names: list[str], cuts: list[list[float]], used: list[int], leaves: int, bins: int,
              rate: float, min_rows: int = MIN_ROWS, min_hessian: float = MIN_HESSIAN) -> dict[int, dict] | None:
    """A best-first tree on `rows` (_bins, _g, _h), with steps of `rate`; None without rows."""
    found = _sums(rows, None, len(names), bins)
    if not found:
        return None
    nodes = {1: _best(Node(found[1]), used, min_rows, min_hessian)}
    while True:
        splits, unknown = _grown(nodes, leaves)
        if not unknown:
            break
        shape = _table(nodes, splits, names, cuts, rate)
        smaller = {}
        for n in unknown:
            smaller[2 * n if 2 * nodes[n].left_rows <= nodes[n].sums[0, :, 2].sum() else 2 * n + 1] = n
        where = tree_sql(shape, lambda n, _: f"{n}L" if n in smaller else "CAST(NULL AS BIGINT)", binned_test)
        found = _sums(rows, where, len(names), bins)
        for child, parent in smaller.items():
            nodes[child] = _best(Node(found[child]), used, min_rows, min_hessian)
            nodes[child ^ 1] = _best(Node(nodes[parent].sums - found[child]), used, min_rows, min_hessian)
    return _table(nodes, splits, names, cuts, rate)


def _table(nodes, splits, names, cuts, rate) -> dict[int, dict]:
    """Rows of the model table by node. Leaves without sums of their own take them from the split above."""
    tree = {}
    for n in splits:
        node = nodes[n]
        tree[n] = {"rows": int(node.sums[0, :, 2].sum()), "feature": names[node.feature],
                   "threshold": cuts[node.feature][node.bin], "gain": node.gain, "at": node.feature, "bin": node.bin}
        below = node.sums[node.feature, :node.bin + 1].sum(axis=0)
        for child, (g, h, count) in ((2 * n, below), (2 * n + 1, node.sums[node.feature].sum(axis=0) - below)):
            tree.setdefault(child, {"rows": int(count), "value": float(-rate * ((g / UNIT) / (h / UNIT)))})
    for n in splits:
        tree[n].pop("value", None)
    if not splits:
        g, h, count = nodes[1].sums[0].sum(axis=0)
        tree[1] = {"rows": int(count), "value": float(-rate * ((g / UNIT) / (h / UNIT))) if h > 0 else 0.0}
    return tree


def fit_leafwise(train: DataFrame, label: str = "HIGH_ACTIVITY", names=S.MODEL_FEATURES, trees: int = TREES,
                 rate: float = RATE, leaves: int = LEAVES, bins: int = BINS, sampling: float = SAMPLING, seed: int = SEED,
                 min_rows: int = MIN_ROWS, min_hessian: float = MIN_HESSIAN) -> LeafwiseModel:
    """Boosted best-first trees; `sampling` is the share of rows and of inputs that each tree sees.

    Rows are kept as bins, label and score. Each tree is added to the scores of the last checkpoint, which is made every
    `CUT_EVERY` trees in the shared folder, so plans stay short and a lost executor costs a few trees of its rows.
    """
    names = list(names)
    kept = train.filter(F.col(label).isNotNull()).select(
        *[F.col(f"`{n}`").cast("double").alias(n) for n in names], F.col(label).cast("int").alias("_y"))
    held = kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total, high = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
        share = min(max(high / total, EDGE), 1 - EDGE) if total else 0.5
        model = LeafwiseModel(names, math.log(share / (1 - share)))
        if not 0 < high < total:
            return model
        cuts = bin_cuts(kept, names, bins)
        limits = F.array(*[F.array(*[F.lit(c) for c in cut]).cast("array<double>") for cut in cuts])
        placed = F.array(*[range_of(F.col("_cuts")[i], F.col(f"`{n}`")) for i, n in enumerate(names)])
        base = cut_lineage(kept.withColumn("_cuts", limits).select(
            placed.cast("array<smallint>").alias("_bins"), "_y", F.lit(model.start).alias("_f")))
        score, drawn = F.col("_f"), random.Random(seed)
        for t in range(trees):
            if t and t % CUT_EVERY == 0:
                base, score = cut_lineage(base.withColumn("_f", score)), F.col("_f")
            p = logistic(F.col("_f"))
            ready = base.withColumn("_f", score).select(
                "_bins", F.round((p - F.col("_y")) * UNIT).cast("bigint").alias("_g"),
                F.round(p * (1.0 - p) * UNIT).cast("bigint").alias("_h"))
            used = sorted(drawn.sample(range(len(names)), max(1, round(sampling * len(names)))))
            if sampling < 1:
                ready = ready.filter(F.pmod(F.xxhash64("_bins", F.lit(seed), F.lit(t)), F.lit(1 << 20)) < int(sampling * (1 << 20)))
            ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
            tree = grow_tree(ready, names, cuts, used, leaves, bins, rate, min_rows, min_hessian)
            held.unpersist()
            held = ready
            if tree:
                score = score + F.expr(tree_sql(tree, test=binned_test))
                model.trees.append({n: {k: v for k, v in r.items() if k not in ("at", "bin")} for n, r in tree.items()})
        return model
    finally:
        held.unpersist()
