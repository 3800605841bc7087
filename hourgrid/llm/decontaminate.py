"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised to words and put into one suffix automaton. Documents stream through it:
after each word the automaton knows the longest suffix of the words read that occurs in some item. Where
that length reaches the window, or the suffix ends with a whole item shorter than a window, the words are hit.

The automaton is broadcast. Items are dealt to as many automata as keep each under `SHARD_WORDS` words, and
documents pass through them one after the other, so what a task holds has a fixed bound however many
items there are. Documents are never shuffled.

Cases: null text has no words. An item without words has no window. Repeated items count once by id; a null
item id hits words but is not listed. Repeated documents each get their row. Other columns are kept, whatever their names.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import storage, words

WINDOW = 10
SHARD_WORDS = 200_000
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MATCH = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class Automaton:
    """Suffix automaton of many word sequences, by numbers of words in its vocabulary."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.array([w for _, ws in items for w in ws], dtype=np.uint64))
        coded = [(name, np.searchsorted(self.vocabulary, np.array(ws, dtype=np.uint64)).tolist())
                 for name, ws in items if ws]
        size = len(self.vocabulary)
        self.pairs = np.unique(np.array(
            [a * size + b for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)], dtype=np.int64))
        self.length, self.link, self.next = [0], [-1], [{}]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        # The state that holds the last `window` words of a state's strings.
        self.windowed = list(range(len(self.length)))
        for v in sorted(self.windowed, key=self.length.__getitem__):
            up = self.link[v]
            if up >= 0 and self.length[up] >= window:
                self.windowed[v] = self.windowed[up]
        # Items by the state of a window, with the window's length.
        self.items: dict[int, dict[int, set]] = {}
        for name, ws in coded:
            state, n = 0, 0
            for w in ws:
                state, n = self.step(state, n, w)
                if n >= window:
                    self._mark(self.windowed[state], window, name)
            if len(ws) < window:
                while self.length[self.link[state]] >= len(ws):
                    state = self.link[state]
                self._mark(state, len(ws), name)
        short = {v for v, by in self.items.items() if any(n < window for n in by)}
        # The nearest state on the way to the root, itself included, at which a short item ends.
        self.ends_short = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.ends_short[v] = v if v in short else self.ends_short[self.link[v]] if v else -1
        lengths = [min(len(ws), window) for _, ws in coded]
        self.least = min([n for n in lengths if n > 1], default=0)
        self.single = np.unique(np.array([ws[0] for _, ws in coded if len(ws) == 1], dtype=np.int64))

    def _mark(self, state: int, n: int, name):
        self.items.setdefault(state, {}).setdefault(n, set()).add(name)

    def _copy(self, p: int, w: int, q: int) -> int:
        """Split `q`, reached from `p` by `w`, so that the shorter strings get a state of their own."""
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, w, q)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, w, q)
        return new

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while w not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            n = self.length[state]
        return self.next[state][w], n + 1

    def scan(self, ws: list[int]) -> tuple[list[tuple[int, int]], set, int]:
        """Ranges of hit words (merged), names of items with an occurring window, longest match."""
        state, n, longest, ranges, names = 0, 0, 0, [], set()
        for i, w in enumerate(ws):
            state, n = self.step(state, n, w)
            longest = max(longest, n)
            reach = 0
            if n >= self.window:
                reach = self.window
                names |= self.items[self.windowed[state]].get(self.window, set())
            at = self.ends_short[state]
            while at >= 0:
                for size, found in self.items[at].items():
                    if size <= n and size < self.window:
                        reach = max(reach, size)
                        names |= found
                at = self.ends_short[self.link[at]] if at else -1
            if reach:
                lo = i + 1 - reach
                while ranges and ranges[-1][1] >= lo:
                    lo = min(lo, ranges.pop()[0])
                ranges.append((lo, i + 1))
        return ranges, names, longest

    def stretches(self, hashes: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, past the last, numbers): the parts of texts in which a window can occur.

        Between two of them the automaton would fall back to the root or stay below any window: a
        word is unknown, or two neighbours never stand side by side in an item.
        """
        size = len(self.vocabulary)
        if not size or not len(hashes):
            return
        number = np.searchsorted(self.vocabulary, hashes)
        number[number == size] = 0
        known = self.vocabulary[number] == hashes
        joined = np.zeros(len(hashes), dtype=bool)  # with the word before
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(self.pairs) and len(both):
            pair = number[both - 1] * size + number[both]
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            joined[both[self.pairs[at] == pair]] = True
        joined[cuts[:-1][cuts[:-1] < len(hashes)]] = False
        first = np.flatnonzero(known & ~joined)
        if not len(first):
            return
        follows = np.append(joined[1:], False)
        past = np.flatnonzero(known & ~follows) + 1
        keep = (past - first >= self.least) if self.least else np.zeros(len(first), dtype=bool)
        if len(self.single):
            alone = np.cumsum(np.append(0, known & np.isin(number, self.single)))
            keep |= alone[past] > alone[first]
        for lo, hi in zip(first[keep].tolist(), past[keep].tolist(), strict=True):
            yield lo, hi, number[lo:hi].tolist()


def item_automata(items: DataFrame, window: int) -> list:
    """One broadcast automaton for every `SHARD_WORDS` words of items."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", " ")) + F.length("text") / 6)).first()[0] or 0
    shards = 1 + int(total // SHARD_WORDS)
    made = []
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = [(r.item_id, item_words(r.text)) for r in part.toLocalIterator()]
        made.append(spark.sparkContext.broadcast(Automaton(rows, window)))
    return made


def item_words(text: str) -> list[int]:
    return [int(h) for b in words.blocks(pa.array([text]))
            for h in words.hash_words(b, words.find_words(b, words.ALNUM))]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _matcher(text: str, column: str, shared, first: bool):
    """Adds (or widens) the match struct of each row; spans are word ranges and byte ranges."""

    def scan(batches):
        automaton = shared.value
        for batch in batches:
            rows = [None] * batch.num_rows
            texts = batch.column(text)
            for block in words.blocks(texts):
                found = words.find_words(block, words.ALNUM)
                hashes = words.hash_words(block, found)
                cuts = found.cuts.tolist()
                hits: dict[int, list] = {}
                for lo, hi, numbers in automaton.stretches(hashes, found.cuts):
                    ranges, names, longest = automaton.scan(numbers)
                    if ranges:
                        hits.setdefault(bisect_right(cuts, lo) - 1, []).append(
                            ([(lo + a, lo + b) for a, b in ranges], names, longest))
                for i in range(len(block.bounds) - 1):
                    at, base = int(found.cuts[i]), int(block.bounds[i])
                    got = hits.get(i, [])
                    ranges = [r for rs, _, _ in got for r in rs]
                    rows[block.first + i] = {
                        "n_words": int(found.cuts[i + 1]) - at,
                        "longest": max((n for _, _, n in got), default=0),
                        "items": sorted({x for _, names, _ in got for x in names if x is not None}),
                        "ranges": [(a - at, b - at) for a, b in ranges],
                        "spans": [(int(found.starts[a]) - base, int(found.ends[b - 1]) - base) for a, b in ranges],
                    }
            if not first:
                for row, old in zip(rows, batch.column(column).to_pylist(), strict=True):
                    row["longest"] = max(row["longest"], old["longest"])
                    row["items"] = sorted({*row["items"], *old["items"]})
                    row["ranges"] += [(x["start"], x["end"]) for x in old["ranges"]]
                    row["spans"] += [(x["start"], x["end"]) for x in old["spans"]]
            out = []
            for row in rows:
                ranges = merged(row["ranges"])
                out.append({
                    "n_words": row["n_words"], "n_hit": sum(b - a for a, b in ranges), "longest": row["longest"],
                    "spans": [{"start": a, "end": b} for a, b in merged(row["spans"])], "items": row["items"],
                    "ranges": [{"start": a, "end": b} for a, b in ranges],
                })
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()),
                              ("spans", span), ("items", pa.list_(pa.string())), ("ranges", span)])
            made = pa.array(out, type=kind)
            columns = batch.columns if first else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, made], names=[*batch.schema.names[:len(columns)], column])

    return scan


def match_items(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "match",
                window: int = WINDOW) -> DataFrame:
    """`docs` with a struct `into`: n_words, n_hit, longest, spans (byte ranges), items, ranges (of words).

    `items` has item_id and text. `into` must not be a column of `docs`.
    """
    storage.bounded_batches(docs)
    kind = T.StructType([*MATCH.fields, T.StructField("ranges", T.ArrayType(SPAN))])
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])
    for scan in _matchers(items, text, into, window):
        docs = docs.mapInArrow(scan, schema)
    return docs


def _matchers(items: DataFrame, text: str, into: str, window: int) -> list:
    return [_matcher(text, into, shared, k == 0) for k, shared in enumerate(item_automata(items, window))]


def _without(batches, text: str, column: str, coverage: float):
    """Cut the byte ranges out of the text; what stood on both sides is joined by one space."""
    for batch in batches:
        texts, found = batch.column(text), batch.column(column)
        n_hit, n_words, spans = (found.field(n) for n in ("n_hit", "n_words", "spans"))
        hit = pa.compute.greater(n_hit, 0).to_numpy(zero_copy_only=False)
        if hit.any():
            made = texts.to_pylist()
            for i in np.flatnonzero(hit).tolist():
                data, at, parts = made[i].encode(), 0, []
                for span in spans[i].as_py():
                    parts.append(data[at:span["start"]].rstrip(b" "))
                    at = span["end"]
                parts.append(data[at:].lstrip(b" "))
                made[i] = b" ".join(p for p in parts if p).decode()
            texts = pa.array(made, type=texts.type)
        names = [n for n in batch.schema.names if n != column]
        kept = pa.array(n_hit.to_numpy() <= coverage * n_words.to_numpy())
        yield pa.RecordBatch.from_arrays(
            [texts if n == text else batch.column(n) for n in names], names=names).filter(kept)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Documents without the spans that occur in `items`; the columns stay as they are.

    A span is removed when it matches at least `window` words or a whole shorter item. A document of
    which more than `coverage` of the words is hit goes as a whole.
    """
    storage.bounded_batches(docs)
    into = storage.free_name(docs, "match")
    scans = _matchers(items, "text", into, window)

    def clean(batches):
        for scan in scans:  # one after the other on each batch, in one worker
            batches = scan(batches)
        yield from _without(batches, "text", into, coverage)

    return docs.mapInArrow(clean, docs.schema)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = storage.table(spark, folder, "documents").select("doc_id", "text")
    found = match_items(docs, storage.table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "match.n_words", "match.n_hit", F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "match.items"), 256).alias("items_sha256"),
        (F.col("match.n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH cleaned AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM asked WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM cleaned, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
          (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
           FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cleaned c LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
