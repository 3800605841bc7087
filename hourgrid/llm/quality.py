"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of n-grams hashed to buckets: words and word pairs, runs of character classes, and
runs of one repeated word. Each bucket's class log-count ratio comes from all labelled rows, summed over the partitions.
Indicators scaled by the ratios then train a linear hinge-loss model by dual coordinate descent, on about `SAMPLE_ROWS`
labelled rows chosen by hash. The weights are mixed with their mean size, as the method has it. A part of the sample
fits the sigmoid that turns margins into probabilities.

Cases: null and empty texts have no features and get the score of the bias. Without labels of both classes every score
is 0.5. Rows whose label is null are not learned from. Repeated rows each get their row; repeated labels of a document
count as rows. Null ids have no label. Result columns replace columns of the same name.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import storage, words
from hourgrid.llm.linear_text import byte_grams, fold, fold_of, sigmoid

BITS = 16
SAMPLE_ROWS = 6000
CUT = 0.7
SMOOTHING, COST, EPOCHS, MIX = 1.0, 1.0, 15, 0.25
CALIBRATION = 4
SHAPE_WIDTHS = (3, 5)
REPEATS = (1, 2, 4, 8)
BUCKETS = (1 << BITS) + len(REPEATS)  # those of repeats lie behind the hashed ones
ADDED = ("score", "predicted")

# Character classes: small letters, capitals, digits, white space; punctuation stands for itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
SHAPE[[9, 10, 11, 12, 13, 32]] = 32


def features(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct buckets of each text."""
    out = []
    shift = np.uint64(64 - BITS)
    for block in words.blocks(column):
        found = words.find_words(block, words.SPACED)
        single = words.hash_words(block, found)
        pairs = words.hash_runs(single, 2)
        same = np.append(False, single[1:] == single[:-1])
        runs = np.arange(len(same)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else same
        single_at, pair_at = ((h >> shift).astype(np.int32) for h in (single, pairs))
        shapes = [byte_grams(block, w, BITS, SHAPE, w) for w in SHAPE_WIDTHS]
        cuts = found.cuts.tolist()
        for i in range(len(cuts) - 1):
            lo, hi = cuts[i], cuts[i + 1]
            parts = [single_at[lo:hi], pair_at[lo:max(hi - 1, lo)]]
            parts += [h[c[i]:c[i + 1]].astype(np.int32) for h, c in shapes]
            repeat = int(runs[lo + 1:hi].max(initial=0)) if hi - lo > 1 else 0
            parts.append(np.array([(1 << BITS) + k for k, n in enumerate(REPEATS) if repeat >= n], dtype=np.int32))
            out.append(np.unique(np.concatenate(parts)))
    return out


def _count(batches):
    """Documents of each class by bucket, over the whole partition."""
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for at, label in zip(features(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            totals[label][at] += 1
            rows[label] += 1
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(totals[0][used], rows[0]), pa.int64()),
         pa.array(np.append(totals[1][used], rows[1]), pa.int64())], names=["at", "low", "high"])


def _sparse(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("label"), pa.array(features(batch.column("text")), pa.list_(pa.int32()))],
            names=["key", "label", "at"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum()) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.offset)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, seed: int = 5):
    """Weights and bias of the L2-regularised hinge-loss model over `scale`d indicators; `y` is -1 or 1."""
    w = np.zeros(len(scale) + 1)  # the last one is the bias
    alpha = np.zeros(len(rows))
    values = [scale[at] for at in rows]
    size = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i], values[i]
            slope = y[i] * (float(w[at] @ v) + w[-1]) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), COST)
            if new != alpha[i]:
                move = (new - alpha[i]) * y[i]
                w[at] += move * v
                w[-1] += move
                alpha[i] = new
    return w[:-1], float(w[-1])


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with the usual smoothed targets."""
    high, low = positive.sum(), (~positive).sum()
    target = np.where(positive, (high + 1) / (high + 2), 1 / (low + 2))
    scale = max(float(np.abs(margins).mean()), 1e-9)
    m = margins / scale
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * m + b)
        g = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * m * m).sum() + 1e-3, (d * m).sum()], [(d * m).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-7:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label",
        rows: int = SAMPLE_ROWS) -> Model:
    """A model of the texts of `docs` that have a label (0 or 1) in `labels`; both have the column `key`.

    Labels, of which there may be as many as documents, meet the texts by an exchange; only the rows of the sample are broadcast.
    The sample is put in an order of its own, so the model does not depend on how rows lie in files.
    """
    storage.bounded_batches(docs)

    def ident(df):
        return df[key].cast("string").alias("key")

    marks = storage.staged(labels.filter(F.col(f"`{label}`").isin(0, 1)).select(
        ident(labels), F.col(f"`{label}`").cast("int").alias("label")), "labels")
    texts = docs.select(ident(docs), F.col(f"`{text}`").alias("text"))
    counts = texts.join(marks.hint("merge"), "key").select("label", "text").mapInArrow(
        _count, "at int, low long, high long").groupBy("at").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high")).toPandas()  # one row a bucket at most
    total = counts[counts["at"] == -1]
    low, high = (int(total[c].sum()) for c in ("low", "high"))
    size = BUCKETS
    if not low or not high:
        return Model(np.zeros(size), 0.0, 0.0, 0.0)
    share = min(rows / (low + high), 1.0)
    chosen = marks.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = texts.join(F.broadcast(chosen), "key").select("key", "label", "text").mapInArrow(
        _sparse, "key string, label int, at array<int>").collect()  # the chosen labels are about `rows`
    sample.sort(key=lambda r: (fold_of(r["key"], 1 << 32), r["key"], r["label"], r["at"]))
    counts = counts[counts["at"] >= 0]
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    p[counts["at"]] += counts["high"]
    q[counts["at"]] += counts["low"]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = [np.array(r["at"], dtype=np.int32) for r in sample]
    y = np.array([1.0 if r["label"] else -1.0 for r in sample])
    held = (np.arange(len(x)) % CALIBRATION == 0) & (len(x) >= 8 * CALIBRATION)
    chosen = np.flatnonzero(~held)
    w, bias = dual_coordinate_descent([x[i] for i in chosen], y[chosen], ratio)
    w = (1 - MIX) * np.abs(w).mean() + MIX * w
    model = Model(w * ratio, MIX * bias, 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else np.arange(len(x))
    margins = np.array([model.margin(x[i]) for i in test])
    model.slope, model.offset = fit_sigmoid(margins, y[test] > 0)
    return model


def _score(text: str, shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ADDED]
            margins = np.array([model.margin(at) for at in features(batch.column(text))])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(model.scores(margins), pa.float64())], names=[*names, "score"])

    return score


def rate(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """`docs` with score (0 to 1) and predicted."""
    storage.bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    scored = docs.mapInArrow(_score(text, docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = storage.table(spark, folder, "documents").select("doc_id", "text")
    labels = storage.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    learned = fold(F.col("doc_id"), 4) != 2
    model = fit(docs.filter(learned), labels.filter(learned))
    return rate(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
