"""Ranked lexical search by pipelined term partitioning.

Documents are dealt to blocks of a bounded size, in the task that reads them. A block's inverted index holds, for
each term that any item asks for, the documents, occurrences and lengths; terms have `OWNERS` owners by hash, and the
index is written by owner. Items are dealt to bundles. A bundle visits the owners one after the
other: at each, a cogroup by (block, bundle) adds the integer contributions of the owner's terms to the sparse
accumulators that the bundle carries for the block's documents, and sends them on. Behind the last owner each bundle keeps
its best documents of the block; tasks merge them, and one window per item picks the final ones.

Every document with a term of the item is scored in full. A cogroup holds at most
2048 * 256 accumulators (`Sizes`), whatever the tables' sizes; very common terms are spread over all blocks. Which terms items ask for is
first told by a table of 2**23 bits (1 MB, however many items there are); a term that passes it by chance
falls out in the join by term. Only the two corpus totals reach the driver.

Cases: a null or empty text has no terms; such a document is in no result and such an item has none. A row is a
document or item of its own, also when its id repeats or is null; null ids come first among equal scores. An
empty table gives an empty result. Other columns are not read. Terms are compared by 64-bit hashes.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import storage, words

BEST = 20
OWNERS = 4
FILTER_BITS = 23


@dataclass(frozen=True)
class Sizes:
    """Most documents and postings of a block (one document may pass the second), items and terms of a bundle, rows held to merge."""

    docs: int = 2048
    postings: int = 1 << 20
    items: int = 256
    terms: int = 1 << 18
    held: int = 200_000


ACCUMULATORS = "block long, bundle long, places binary, scores binary"


def _term_counts(column: pa.Array, wanted: np.ndarray | None):
    """For each block of texts: first text, terms of each text, and (text, term, count) of the terms `wanted` lets pass."""
    for block in words.blocks(column):
        found = words.find_words(block, words.ALNUM)
        hashes = words.hash_words(block, found)
        lengths = np.diff(found.cuts)
        texts = np.repeat(np.arange(len(lengths)), lengths)
        if wanted is not None:
            at = hashes >> np.uint64(64 - FILTER_BITS)
            keep = (wanted[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            hashes, texts = hashes[keep], texts[keep]
        order = np.lexsort((hashes, texts))
        hashes, texts = hashes[order], texts[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(hashes)))
        yield block.first, lengths, texts[starts], hashes[starts], counts


def _own_number() -> int:
    """A number that no other task of the stage counts from."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def _asking(id_type: pa.DataType, sizes: Sizes):
    """Rows (bundle, item, item_id, term, times) of the items."""

    def ask(batches):
        bundle, item, terms = _own_number(), 0, 0
        for batch in batches:
            for first, lengths, texts, hashes, counts in _term_counts(batch.column("text"), None):
                bounds = np.searchsorted(texts, np.arange(len(lengths) + 1))
                where = np.zeros((len(lengths), 2), dtype=np.int64)
                for i in range(len(lengths)):
                    here = int(bounds[i + 1] - bounds[i])
                    if item == sizes.items or item and terms + here > sizes.terms:
                        bundle, item, terms = bundle + 1, 0, 0
                    where[i] = bundle, item
                    item, terms = item + 1, terms + here
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[texts, 0]), pa.array(where[texts, 1].astype(np.int32)),
                     batch.column("id").take(pa.array(first + texts)).cast(id_type), pa.array(hashes.view(np.int64)),
                     pa.array(counts.astype(np.int64))], names=["bundle", "item", "item_id", "term", "times"])

    return ask


def _pieces(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of the pieces of `values` between `bounds`."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _block_rows(block: int, ids: pa.Array, lengths: np.ndarray, texts: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
    """The rows of one block: its documents (owner -1, in the order of their ids) and a row for each term."""
    order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    texts = place[texts]
    by = np.lexsort((texts, hashes))
    texts, hashes, counts = texts[by], hashes[by], counts[by]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, dtype=np.int64)
    bounds = np.append(starts, len(hashes))
    n = len(starts)
    terms = hashes[starts]
    none = pa.nulls(1)
    ids_list = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
    lists = ids_list.type
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), none.cast(pa.int64()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
         none.cast(pa.binary()), none.cast(pa.binary()), none.cast(pa.binary()), ids_list, pa.array([-1], pa.int32())], names=INDEX)
    step = 4096
    for lo in range(0, n, step):
        cut = bounds[lo:lo + step + 1]
        here, span = len(cut) - 1, slice(cut[0], cut[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(here, block)), pa.array(terms[lo:lo + here].view(np.int64)), pa.array(np.diff(cut)), pa.nulls(here, pa.int64()),
             _pieces(texts[span].astype(np.uint16), cut - cut[0]), _pieces(counts[span].astype(np.uint32), cut - cut[0]),
             _pieces(lengths[order][texts[span]].astype(np.uint32), cut - cut[0]), pa.nulls(here, lists),
             pa.array((terms[lo:lo + here] % np.uint64(OWNERS)).astype(np.int32))], names=INDEX)


INDEX = ["block", "term", "n_docs", "n_terms", "docs", "times", "lengths", "ids", "owner"]


def _indexing(wanted: np.ndarray, sizes: Sizes):
    def index(batches):
        block = _own_number()
        held, docs, postings = [], 0, 0

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            return _block_rows(block, ids, *(np.concatenate([h[k] for h in held]) for k in range(1, 5)))

        for batch in batches:
            for first, lengths, texts, hashes, counts in _term_counts(batch.column("text"), wanted):
                for lo in range(0, len(lengths), sizes.docs):  # a block of texts may hold more documents than fit
                    n = len(lengths[lo:lo + sizes.docs])
                    a, b = np.searchsorted(texts, [lo, lo + n])
                    if held and (docs + n > sizes.docs or postings + b - a > sizes.postings):
                        yield from flush()
                        block, held, docs, postings = block + 1, [], 0, 0
                    ids = batch.column("id").slice(first + lo, n)
                    held.append((ids, lengths[lo:lo + n], texts[a:b] - lo + docs, hashes[a:b], counts[a:b]))
                    docs, postings = docs + n, postings + int(b - a)
        if held:
            yield from flush()

    return index


def _asked_bits(asked: DataFrame) -> np.ndarray:
    """The bits of the terms of `asked`; at most 2**17 words of 64 bits come to the driver."""
    at = F.shiftrightunsigned("term", 64 - FILTER_BITS).alias("at")
    rows = asked.select(at).groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(1L << cast(at & 63 as int))").alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in rows:
        bits[r.word] = r.bits
    return bits.view(np.uint8)


def _visit(n_docs: int, n_terms: int, last: bool, best: int, sizes: Sizes):
    """Adds an owner's contributions to the accumulators of one bundle and block."""

    def visit(key, carried: pa.Table, owned: pa.Table) -> pa.Table:
        scores = np.zeros(sizes.items * sizes.docs, dtype=np.int64)
        for row in carried.select(["places", "scores"]).to_pylist():
            scores[np.frombuffer(row["places"], np.uint32)] = np.frombuffer(row["scores"], np.int64)
        if owned.num_rows:
            docs, times, lengths = (np.frombuffer(b"".join(owned.column(c).to_pylist()), dtype).astype(np.int64)
                                    for c, dtype in (("docs", np.uint16), ("times", np.uint32), ("lengths", np.uint32)))
            m = 75 + (25 * lengths * n_docs) // n_terms
            parts = (1_000_000_000 * times) // (1000 * times + 12 * m)
            at = 0
            for n, weight, items in zip(*(owned.column(c).to_pylist() for c in ("n_docs", "weight", "items")), strict=True):
                here = weight * parts[at:at + n]
                for asked in items:
                    scores[asked["item"] * sizes.docs + docs[at:at + n]] += asked["times"] * here
                at += n
        places = np.flatnonzero(scores)
        scores = scores[places]
        if last:  # documents lie in the order of their ids
            order = np.lexsort((places, -scores, places // sizes.docs))
            items = places[order] // sizes.docs
            rank = np.arange(len(items)) - np.searchsorted(items, items)
            keep = np.sort(order[rank < best])
            places, scores = places[keep], scores[keep]
        return pa.table({"block": [key[0].as_py()], "bundle": [key[1].as_py()],
                         "places": pa.array([places.astype(np.uint32).tobytes()], pa.binary()),
                         "scores": pa.array([scores.tobytes()], pa.binary())})

    return visit


def _merging(best: int, sizes: Sizes):
    """Documents by id, and only the best of each item among those that the task has seen."""

    def cut(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held)
        keys = [("bundle", "ascending"), ("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start"))
        bundle, item = t.column("bundle").to_numpy(), t.column("item").to_numpy()
        new = np.append(True, (bundle[1:] != bundle[:-1]) | (item[1:] != item[:-1])) if len(t) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        rank = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
        return t.filter(pa.array(rank < best))

    def merge(batches):
        held, rows = [], 0
        for batch in batches:
            for i in range(len(batch)):
                places = np.frombuffer(batch.column("places")[i].as_py(), np.uint32)
                items, docs = places // sizes.docs, places % sizes.docs
                held.append(pa.table({
                    "bundle": np.full(len(places), batch.column("bundle")[i].as_py(), dtype=np.int64), "item": items.astype(np.int32),
                    "doc_id": batch.column("ids")[i].values.take(pa.array(docs)),
                    "score": np.frombuffer(batch.column("scores")[i].as_py(), np.int64)}))
                rows += len(places)
            if rows > sizes.held:
                held = [cut(held)]
                rows = len(held[0])
                if rows > sizes.held // 2:  # very many items: what is held goes on, the window takes care of the rest
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from cut(held).to_batches()

    return merge


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           best: int = BEST, sizes: Sizes = Sizes()) -> DataFrame:
    """The `best` documents of each item: item_id, rank (from 1), doc_id, score (see the formula in `_visit`).

    Weight of a term: floor(1000 * ln((2N + 2) / (2 df + 1))). Equal scores go by ascending document id.
    """
    spark = storage.bounded_batches(docs).sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type, item_type = docs.schema["id"].dataType.simpleString(), items.schema["id"].dataType
    asked = storage.staged(items.mapInArrow(
        _asking(_arrow(item_type), sizes), f"bundle long, item int, item_id {item_type.simpleString()}, term long, times long"), "asked")
    index = storage.staged(docs.mapInArrow(
        _indexing(_asked_bits(asked), sizes), "block long, term long, n_docs long, n_terms long, docs binary, times binary, lengths binary, "
        f"ids array<{id_type}>, owner int"), "index", by=("owner",))
    blocks = index.filter("owner = -1").select("block", "ids", "n_docs", "n_terms")
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = total[0], max(total[1], 1)

    held = index.filter("owner >= 0").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    terms = asked.groupBy("term", "bundle").agg(F.collect_list(F.struct("item", "times")).alias("items")).join(held, "term").select(
        "term", "bundle", "items", weight.cast("long").alias("weight"), F.expr(_owner_of("term")).alias("owner"))
    terms = storage.staged(terms, "terms", by=("owner",))

    carried = spark.createDataFrame([], ACCUMULATORS)
    for owner in range(OWNERS):
        here = F.col("owner") == owner
        owned = index.filter(here).select("block", "term", "n_docs", "docs", "times", "lengths").join(
            terms.filter(here).select("term", "bundle", "items", "weight"), "term").drop("term")
        visit = _visit(n_docs, n_terms, owner == OWNERS - 1, best, sizes)
        carried = carried.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInArrow(visit, ACCUMULATORS)
    chosen = carried.join(blocks.select("block", "ids"), "block").select("bundle", "places", "scores", "ids").mapInArrow(
        _merging(best, sizes), f"bundle long, item int, doc_id {id_type}, score long")
    by_score = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    chosen = chosen.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= best)
    names = asked.select("bundle", "item", "item_id").distinct()
    return chosen.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _owner_of(term: str) -> str:
    """SQL of an unsigned 64-bit number modulo OWNERS (a power of two)."""
    return f"cast({term} & {OWNERS - 1} as int)"


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(storage.table(spark, folder, "documents"), storage.table(spark, folder, "benchmark"))


ORACLE_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, total GROUP BY term),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS part
  FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score FROM scores)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20
"""
