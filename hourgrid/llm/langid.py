"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte trigrams, hashed to buckets; a softmax over languages follows.
Both layers are trained together by stochastic gradient descent in NumPy, on about `SAMPLE_ROWS` labelled rows in equal shares
of the languages, chosen by hash. Every language of the labelled rows is learned. A part of the sample is kept for calibration: a temperature makes the score a
probability, and the rejection threshold is the lowest that reaches `TARGET` accuracy on accepted texts, but no
higher than rejects `MOST_REJECTED` of the right ones. Whole texts are scored in Arrow batches; the two layers are folded
into one table of buckets by languages.

Cases: null text, text without a letter, or no labelled rows at all: language `und`, score 0, rejected. Repeated rows each get
their row. Rows with null language are not learned from. Result columns replace columns of the same name.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import storage, words
from hourgrid.llm.linear_text import byte_grams, fold, fold_of, segment_sums

BITS, WIDTH, DIMENSIONS = 13, 3, 16
SAMPLE_ROWS = 4000
LEAST_ROWS = 10  # of a language, where it has so many; with very many languages the sample grows beyond `SAMPLE_ROWS`
EPOCHS, STEPS, BATCH, RATE = 14, 1500, 32, 2.0  # at least so many epochs and steps
CALIBRATION = 5  # one sample row of so many
TARGET, MOST_REJECTED = 0.98, 0.001
UNKNOWN = "und"
LETTER = r"\p{L}"
ADDED = ("lang_pred", "score", "accepted")

# Case is folded for ASCII; digits and punctuation become spaces.
FOLD = words.LOWER.copy()
FOLD[~words.ALNUM] = 32
FOLD[48:58] = 32


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, z: np.ndarray) -> np.ndarray:
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def have_letters(texts: pa.Array) -> list[bool]:
    """Whether a character of a letter category occurs; signs such as a fraction are not letters. Null: no."""
    return pa.compute.match_substring_regex(texts, LETTER).fill_null(False).to_pylist()


def _features(text: str):
    def sparse(batches):
        for batch in batches:
            index, share = [], []
            for block in words.blocks(batch.column(text)):
                grams, cuts = byte_grams(block, WIDTH, BITS, FOLD, 1)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    at, n = np.unique(grams[lo:hi], return_counts=True)
                    index.append(at.astype(np.int32))
                    share.append((n / max(hi - lo, 1)).astype(np.float32))
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(index, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                names=[*names, "at", "share"])

    return sparse


def labelled_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """About `rows` rows (lang, at, share), as even over languages as there are rows; `labelled` has key, text, lang."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    shares, left = {}, max(rows, LEAST_ROWS * len(counts))
    for k, r in enumerate(sorted(counts, key=lambda r: r["count"])):
        take = min(r["count"], left / (len(counts) - k))
        shares[r["lang"]] = take / r["count"]
        left -= take
    if not shares:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    chosen = F.pmod(F.xxhash64("key", "lang"), F.lit(1 << 30)) < F.coalesce(share, F.lit(0.0)) * (1 << 30)
    found = labelled.filter(chosen).select("key", "lang", "text").mapInArrow(
        _features("text"), "key string, lang string, at array<int>, share array<float>").collect()
    return sorted(found, key=lambda r: (fold_of(r.key, 1 << 32), r.lang))


def train(sample: list, seed: int = 4) -> Model:
    languages = sorted({r.lang for r in sample})
    target = np.array([languages.index(r.lang) for r in sample])
    size, k = 1 << BITS, len(languages)
    rng = np.random.default_rng(seed)
    held = np.arange(len(sample)) % CALIBRATION == 0
    held &= len(sample) >= 4 * CALIBRATION

    def dense(rows):
        x = np.zeros((len(rows), size), dtype=np.float32)
        for j, i in enumerate(rows):
            x[j, sample[i].at] = sample[i].share
        return x

    embedding = (rng.standard_normal((size, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    layer = np.zeros((DIMENSIONS, k), dtype=np.float32)
    bias = np.zeros(k, dtype=np.float32)
    fit = np.flatnonzero(~held)
    epochs = max(EPOCHS, -(-STEPS // -(-len(fit) // BATCH)))
    steps = epochs * -(-len(fit) // BATCH)
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), -(-len(fit) // BATCH)):
            rate = RATE * (1 - step / steps)
            x = dense(rows.tolist())
            hidden = x @ embedding
            wrong = softmax(hidden @ layer + bias)
            wrong[np.arange(len(rows)), target[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ layer.T
            layer -= rate * hidden.T @ wrong
            bias -= rate * wrong.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            # Embeddings see gradients scaled by the share of a bucket, so they take longer steps.
            embedding[used] -= 50 * rate * (x[:, used].T @ back)
            step += 1
    table = embedding @ layer
    model = Model(languages, table, bias, 1.0, 0.0)
    test = np.flatnonzero(held)
    if len(test):
        z, y = dense(test.tolist()) @ table + bias, target[test]
        grid = np.geomspace(0.05, 20, 40)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = model.scores(z)
        model.threshold = threshold(p.max(axis=1), p.argmax(axis=1) == y)
    return model


def threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The lowest score at which accepted texts reach `TARGET` accuracy, bounded by `MOST_REJECTED`."""
    order = np.argsort(-score)
    accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(accuracy >= TARGET)
    if len(good) and good[-1] == len(order) - 1:
        return 0.0
    lowest = score[order[good[-1]]] if len(good) else 1.0
    return float(min(lowest, np.quantile(score[right], MOST_REJECTED))) if right.any() else 0.0


def _predict(text: str, shared):
    def predict(batches):
        model = shared.value
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ADDED]
            best, score = [], []
            for block in words.blocks(batch.column(text)):
                n = len(block.bounds) - 1
                if not model.languages:
                    best += [None] * n
                    score += [0.0] * n
                    continue
                grams, cuts = byte_grams(block, WIDTH, BITS, FOLD, 1)
                z = segment_sums(model.table[grams], cuts) / np.maximum(np.diff(cuts), 1)[:, None] + model.bias
                p = model.scores(z)
                best += [model.languages[i] for i in p.argmax(axis=1).tolist()]
                score += p.max(axis=1).tolist()
            letters = [lang is not None and ok for ok, lang in zip(have_letters(batch.column(text)), best, strict=True)]
            best = [b if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            score = [s if ok else 0.0 for s, ok in zip(score, letters, strict=True)]
            accepted = [ok and s >= model.threshold for s, ok in zip(score, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(accepted, pa.bool_())], names=[*names, *ADDED])

    return predict


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    storage.bounded_batches(labelled)
    labelled = labelled.filter(F.col(f"`{lang}`").isNotNull()).select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").alias("text"))
    sample = labelled_sample(labelled, rows)
    return train(sample) if sample else Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (calibrated probability) and accepted."""
    storage.bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("accepted", T.BooleanType())])
    return docs.mapInArrow(_predict(text, docs.sparkSession.sparkContext.broadcast(model)), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(fold(F.col("doc_id"), 4) != 2)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = storage.table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
