"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Documents with equal shingle sets form a class with the smallest id as representative; the join runs on classes.
Two sets that reach the similarity share a shingle among the first quarter (at similarity 3/4) of either in any common
order of shingles, so classes meet at each shingle of that part. Shingles of many documents, counted exactly over all of
them, come last in the order, which keeps passages that many documents share out of that part; the order changes only the
cost, never the result.

1. The least class of a shingle anchors the others with that shingle. Each class is compared with its anchors; links
   found give provisional components.
2. The classes of an anchor that still lie in several components are sorted by size and cut into bands of bounded weight;
   two bands whose sizes can link make a tile. Bitmaps of a tile are compared: bits set on one side only bound the overlap from
   above. Rows with a pair of different components that passes get their texts, and the tile compares such pairs
   exactly, the likeliest first; components that a link joins are not compared again.

A pair inside one provisional component needs no test, since only reachability is asked. Exact comparison intersects the
sorted shingle arrays, made from the two whole texts. Signatures are 64-bit hashes of shingles throughout.

Cases: null text and text without words have no shingles and link with nothing. Texts with fewer words than a shingle are
one shingle. Repeated rows are copies of each other and give equal rows. A null id takes no part in links. Columns
other than id and text are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourgrid.llm import graph, storage, words

WIDTH = 5
SIMILARITY = (75, 100)
TILE = 1024  # sets of at most LEAST_WEIGHT shingles in a band; fewer larger ones
LEAST_WEIGHT = 500
COMMON_SHARE, COMMON_LEAST = 1 / 500, 8  # common is a shingle in more than this share of the documents, and in more than so many
COUNTED_AT_ONCE = 2_000_000  # shingles
COUNTED_DOCS = 4000  # documents for each task that counts, at least
MARKS = 1 << 23
WIDEST = 1 << 15  # bits of a bitmap
SIGNED = "doc_id long, n long, s1 long, s2 long, first array<long>, bits binary"


def needed(a, b):
    """The least intersection of sets of sizes `a` and `b` that link: 100 * i >= 75 * (a + b - i)."""
    low, high = SIMILARITY
    return -(-low * (a + b) // (low + high))


def prefix_length(n: int) -> int:
    """Shingles of a set of size `n` of which a linked set shares one."""
    low, high = SIMILARITY
    return n - (-(-low * n // high)) + 1


def bitmap_bits(n: int) -> int:
    return min(max(64, 1 << max(n - 1, 1).bit_length()), WIDEST)


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each shingle; as many bits as shingles, rounded up to a power of two."""
    bits = bitmap_bits(len(shingles))
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def fold_bitmap(data: bytes, bits: int) -> np.ndarray:
    """A bitmap narrowed to `bits` by joining its parts, as 64-bit numbers."""
    whole = np.frombuffer(data, dtype=np.uint64)
    return np.bitwise_or.reduce(whole.reshape(-1, bits // 64), axis=0)


def text_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, block by block."""
    for block in words.blocks(column):
        found = words.find_words(block, words.SPACED)
        yield from words.shingle_sets(words.hash_words(block, found), found.cuts, WIDTH)


def _stretches(batches):
    """(distinct shingles, documents of each, documents) of one stretch of documents after the other."""
    def counted(sets):
        return *np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True), len(sets)

    sets, size = [], 0
    for batch in batches:
        for shingles in text_shingles(batch.column("text")):
            sets.append(shingles)
            size += len(shingles)
        if size > COUNTED_AT_ONCE:
            yield counted(sets)
            sets, size = [], 0
    yield counted(sets)


def _often_here(batches):
    """Shingles of more than the share of a stretch's documents, and by how many documents they exceed it."""
    for at, n, docs in _stretches(batches):
        over = n - COMMON_SHARE * docs
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[over > 0].view(np.int64)), pa.array(over[over > 0])], names=["shingle", "over"])


def _count_marked(shared):
    """Documents by shingle in each stretch, of shingles with a mark."""

    def count(batches):
        marks = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").view(bool)
        for at, n, _ in _stretches(batches):
            kept = marks[(at & np.uint64(MARKS - 1)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[kept].view(np.int64)), pa.array(n[kept], pa.int64())], names=["shingle", "n"])

    return count


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in more than `COMMON_SHARE` of all documents, and in more than `COMMON_LEAST`.

    All documents are read twice. A shingle of more than the share of them has more than that in some stretch, and what it
    exceeds there is at least what it exceeds in all. Such shingles mark a place by their last bits; then the documents of all
    shingles at marked places are counted. A document has a bounded share of the result, so its size is at most the mean set
    size over `COMMON_SHARE`.
    """
    spark = docs.sparkSession
    total = docs.count()
    limit = max(total * COMMON_SHARE, COMMON_LEAST)
    texts = docs.select("text").coalesce(max(total // COUNTED_DOCS, 1))  # the smaller a stretch, the more often passes its share
    often = texts.mapInArrow(_often_here, "shingle long, over double").groupBy("shingle").agg(F.sum("over").alias("over"))
    places = often.filter(F.col("over") > limit - total * COMMON_SHARE - 1e-6).select(
        F.col("shingle").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("place")).distinct().toArrow()["place"].to_numpy()
    marks = np.zeros(MARKS, dtype=np.uint8)
    marks[places] = 1
    shared = spark.sparkContext.broadcast(np.packbits(marks, bitorder="little").tobytes())
    counts = texts.mapInArrow(_count_marked(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > limit).select("shingle").toArrow()["shingle"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _sign(shared):
    """(doc_id, n, s1, s2, first shingles, bitmap) of each text; s1 and s2 identify the set."""

    def sign(batches):
        common = shared.value  # None: names only
        for batch in batches:
            rows = {"n": [], "s1": [], "s2": [], "first": [], "bits": []}
            for shingles in text_shingles(batch.column("text")):
                n = len(shingles)
                rows["n"].append(n)
                rows["s1"].append(int(words.mix(shingles).sum(dtype=np.uint64).view(np.int64)))
                rows["s2"].append(int(words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                if n and common is not None:
                    if len(common):
                        at = np.searchsorted(common, shingles)
                        at[at == len(common)] = 0
                        late = common[at] == shingles
                        shingles = np.concatenate([shingles[~late], shingles[late]])
                    rows["first"].append(shingles[:prefix_length(n)].view(np.int64))
                    rows["bits"].append(bitmap(shingles))
                else:
                    rows["first"].append(None)
                    rows["bits"].append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["s1"], pa.int64()),
                 pa.array(rows["s2"], pa.int64()), pa.array(rows["first"], pa.list_(pa.int64())),
                 pa.array(rows["bits"], pa.binary())], names=["doc_id", "n", "s1", "s2", "first", "bits"])

    return sign


def overlap_bound(bits_a: np.ndarray, n_a: int, bits_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most the overlap can be: each bit of one side alone is a shingle the other lacks."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def _pass_bound(batches):
    """Pairs whose bitmaps do not rule out a link."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
            bits = 8 * min(len(x), len(y))
            keep.append(overlap_bound(fold_bitmap(x, bits), n_a[i], fold_bitmap(y, bits), n_b[i]) >= needed(n_a[i], n_b[i]))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _by_tile(batches, names: list[str], handle):
    """Rows (tuples of `names` without the tile) of one tile after the other, handled; batches come sorted by tile."""
    held, tile = [], None
    for batch in batches:
        made = []
        for row in zip(*[batch.column(c).to_pylist() for c in ["tile", *names]], strict=True):
            if row[0] != tile:
                made += handle(tile, held)
                held, tile = [], row[0]
            held.append(row[1:])
        yield made
    yield handle(tile, held)


def _windows(side: np.ndarray, rep: np.ndarray, n: np.ndarray, label: np.ndarray, bits: list[bytes]):
    """(i, j, bound): for each row of a tile, the larger rows of other labels whose bitmaps do not rule out a link.

    Rows come sorted by n. Side 0 stands against itself, side 1 against side 2.
    """
    low, high = SIMILARITY
    width = np.array([8 * len(b) for b in bits])
    for narrow in np.unique(width).tolist():
        # Rows of at least this width, narrowed to it; the smaller set of a pair has the narrower bitmap.
        first = int(np.searchsorted(width, narrow))
        last = int(np.searchsorted(n, n[width == narrow].max() * high // low, side="right"))
        maps = np.stack([fold_bitmap(b, narrow) for b in bits[first:last]])
        for i in np.flatnonzero(width == narrow).tolist():
            near = np.arange(i + 1, int(np.searchsorted(n, n[i] * high // low, side="right")))
            near = near[(label[near] != label[i]) & ((side[near] == 0) | (side[near] != side[i]))]
            if len(near):
                bound = overlap_bound(maps[i - first], n[i], maps[near - first], n[near])
                ok = bound >= needed(n[i], n[near])
                if ok.any():
                    yield i, near[ok], bound[ok]


def _involved(tile, rows: list) -> list[tuple]:
    """The rows of a tile that have a pair left to compare."""
    if len(rows) < 2:
        return []
    rows.sort(key=lambda r: r[2])
    side, rep, n, label = (np.array([r[k] for r in rows]) for k in range(4))
    seen = np.zeros(len(rows), dtype=bool)
    for i, near, _ in _windows(side, rep, n, label, [r[4] for r in rows]):
        seen[i] = True
        seen[near] = True
    return [(tile, *rows[i][:4]) for i in np.flatnonzero(seen).tolist()]


def _scan_tiles(batches):
    for made in _by_tile(batches, ["side", "rep", "n", "label", "bits"], _involved):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)],
                                         names=["tile", "side", "rep", "n", "label"])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _tile_links(tile, rows: list) -> list[tuple]:
    """Links between labels, the likeliest pairs first; labels that a link has joined are not compared again."""
    if len(rows) < 2:
        return []
    rows.sort(key=lambda r: r[2])
    side, rep, n, label = (np.array([r[k] for r in rows]) for k in range(4))
    sets = list(text_shingles(pa.array([r[4] for r in rows], pa.large_string())))
    links = []
    for i, near, bound in _windows(side, rep, n, label, [bitmap(x) for x in sets]):
        for j in near[np.argsort(-bound, kind="stable")].tolist():
            if label[i] != label[j] and overlap(sets[i], sets[j]) >= needed(len(sets[i]), len(sets[j])):
                links.append((int(rep[i]), int(rep[j])))
                label[label == label[j]] = label[i]  # the generator reads the labels as they are now
    return links


def _link_tiles(batches):
    for made in _by_tile(batches, ["side", "rep", "n", "label", "text"], _tile_links):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], pa.int64()) for k in range(2)], names=["a", "b"])


def _intersect(batches):
    """The linked ones of pairs with both texts."""
    for batch in batches:
        keep = []
        for x, y in zip(text_shingles(batch.column("text_a")), text_shingles(batch.column("text_b")), strict=True):
            keep.append(len(x) > 0 and len(y) > 0 and overlap(x, y) >= needed(len(x), len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link; `texts` has rep and text."""
    a, b = (texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_intersect, "a long, b long")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep) of every document; (rep, n, first, bits) of each class.

    Sets are signed twice, so that the wide columns of copies are never stored.
    """
    spark = docs.sparkSession
    none = spark.sparkContext.broadcast(None)
    shared = spark.sparkContext.broadcast(common_shingles(docs))
    signed = docs.select("doc_id", "text").mapInArrow(_sign(shared), SIGNED)
    # Equal sets have equal first shingles and bitmaps; any row of a class serves, and partial sums keep one per task.
    found = signed.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("rep"), F.first("first").alias("first"), F.first("bits").alias("bits"))
    found = storage.staged(found, "classes")
    names = docs.select("doc_id", "text").mapInArrow(_sign(none), SIGNED).select("doc_id", "n", "s1", "s2")
    members = names.join(found.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left").select(
        "doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    return members, found.select("rep", "n", "first", "bits")


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    storage.bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, found = classes_of(docs)
    # The least class of a shingle anchors all classes with that shingle; rows of lonely shingles fall away.
    group = Window.partitionBy("shingle")
    dealt = found.select("rep", F.explode("first").alias("shingle")).withColumn("low", F.min("rep").over(group))
    stars = storage.staged(dealt.filter("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    signs = found.select("rep", "n", "bits")
    a, b = (signs.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    low, high = SIMILARITY
    sized = stars.join(a, "a").join(b, "b").filter(
        (F.col("n_a") * high >= F.col("n_b") * low) & (F.col("n_b") * high >= F.col("n_a") * low))
    near = storage.staged(sized.mapInArrow(_pass_bound, "a long, b long"), "near")
    texts = _texts_of(docs, near.select(F.col("a").alias("rep")).union(near.select("b")))
    star_links = storage.staged(_links(near, texts), "links")
    provisional = graph.components(star_links).select(F.col("node").alias("b"), "component")
    labelled = stars.join(provisional, "b", "left").select(
        F.col("a").alias("anchor"), F.col("b").alias("rep"), F.coalesce("component", "b").alias("label"))
    cross = storage.staged(_tile_comparisons(labelled, signs, docs).distinct(), "links")
    parts = graph.components(star_links.union(cross))
    return members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the documents that stand for the classes `reps`."""
    ids = storage.staged(reps.distinct(), "reps")
    return docs.withColumnRenamed("doc_id", "rep").join(storage.sized(ids), "rep", "left_semi").select("rep", "text")


def _tile_comparisons(labelled: DataFrame, signs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different labels at one anchor; `labelled` has anchor, rep and label.

    Texts go to the tiles only for rows that the bitmaps leave with a pair to compare, once for each tile.
    """
    spark = labelled.sparkSession
    rows = labelled.join(signs.select("rep", "n"), "rep")
    weight = F.greatest("n", F.lit(LEAST_WEIGHT))
    mixed = rows.groupBy("anchor").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.sum(weight).alias("whole"))
    rows = storage.staged(rows.join(mixed.filter("l < m").select("anchor", "whole"), "anchor"), "mixed")
    room = TILE * LEAST_WEIGHT
    small = rows.filter(F.col("whole") <= room).select(
        F.struct("anchor", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("tile"), F.lit(0).alias("side"), "rep", "n", "label")
    # Larger groups: bands by size of like weight, and a tile for each pair of bands whose sizes can link.
    order = Window.partitionBy("anchor").orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, -1)
    banded = rows.filter(F.col("whole") > room).select("anchor", "rep", "n", "label", F.floor(
        F.coalesce(F.sum(weight).over(order), F.lit(0)) / room).cast("int").alias("band"))
    edges = banded.groupBy("anchor", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    low, high = SIMILARITY
    other = edges.select("anchor", F.col("band").alias("other"), F.col("least").alias("o_least"), F.col("most").alias("o_most"))
    tiles = edges.join(other, "anchor").filter(
        (F.col("o_least") * low <= F.col("most") * high) & (F.col("least") * low <= F.col("o_most") * high))
    large = banded.join(tiles.select("anchor", "band", "other"), ["anchor", "band"]).select(
        F.struct("anchor", F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j")).alias("tile"),
        F.when(F.col("band") == F.col("other"), 0).when(F.col("band") < F.col("other"), 1).otherwise(2).alias("side"),
        "rep", "n", "label")
    tiles = small.union(large).select(F.xxhash64("tile").alias("tile"), "side", "rep", "n", "label").join(
        signs.select("rep", "bits"), "rep").select("tile", "side", "rep", "n", "label", "bits")

    def dealt(df):
        return df.repartition(storage.partitions(spark), "tile").sortWithinPartitions("tile", "n")

    left = dealt(tiles).mapInArrow(_scan_tiles, "tile long, side int, rep long, n long, label long")
    left = storage.staged(left, "tiles")
    return dealt(left.join(_texts_of(docs, left.select("rep")), "rep")).mapInArrow(_link_tiles, "a long, b long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of linked documents, that of the smallest id; rows without id stay."""
    grouped = linked_components(docs.select("doc_id", "text"))
    found = storage.staged(grouped.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    ids = found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    kept = docs.filter("doc_id is not null").join(storage.sized(ids), "doc_id", "left_anti").select(docs.columns)
    return _first_rows(kept).union(docs.filter("doc_id is null"))


def _first_rows(docs: DataFrame) -> DataFrame:
    """One row for each id; texts are moved only if some id repeats."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1)
    return docs.dropDuplicates(["doc_id"]) if repeated.take(1) else docs


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return linked_components(storage.table(spark, folder, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reached AS (SELECT doc_id AS node, doc_id AS low FROM documents
            UNION SELECT b, low FROM reached JOIN links ON a = node),
least_of AS (SELECT node, min(low) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM split d LEFT JOIN sizes USING (doc_id) JOIN least_of ON node = d.doc_id
"""
