"""Language-model scores by a hidden Markov model.

Every distinct word of the training texts is counted. The `HEAD` most frequent words emit as themselves; all others
emit by class, the hash of their ending, and a class emits its words by counts discounted by `DISCOUNT`, which leaves
mass for unknown words (one type in each class). So the emission table of the latent states has a fixed size, while word
counts grow with the corpus and are joined by word. The counts of the `RESOLVED` most frequent words are broadcast
(16 bytes each, 17 MB at most), and only tokens of rarer words are exchanged for the join.

States are trained by Baum-Welch. The start comes from all training texts, counted by symbol in `GROUPS` groups by their first
symbol; groups are joined, those that lose least first, until one is left for each state. Then each iteration sends expected
counts of all training texts, summed by partition and then by word class, to the driver: a table of fixed size, like that of
the groups. Texts are cut into
segments for training only; a later segment starts from the states' overall distribution. Scores come from the scaled
forward recursion over the whole text, many texts side by side; texts of over `LONG` tokens multiply the transfer
matrices of their segments, which gives the same likelihood.

Cases: null and empty texts are just the end. A null id counts as empty text for the fold. Repeated rows are scored one
by one. Without training texts every probability is that of an untrained table. Other columns are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import storage, words
from hourgrid.llm.linear_text import fold

HEAD, CLASSES, RESOLVED = 8192, 8192, 1 << 20
STATES, ITERATIONS, SEGMENT, CHUNK = 8, 3, 128, 2048
GROUPS, STAY = 32, 2000.0  # STAY: how often the states of the start follow themselves
DISCOUNT, PRIOR = 0.5, 50.0
LONG = 20_000
END = 1  # the end's word hash


def endings(block: words.Block, found: words.Words) -> np.ndarray:
    """The class of each word: its last three bytes, folded and hashed."""
    low = words.LOWER[block.data].astype(np.uint64)
    packed = np.zeros(len(found.starts), dtype=np.uint64)
    for k in (1, 2, 3):
        at = found.ends - k
        packed = (packed << np.uint64(8)) | np.where(at >= found.starts, low[np.maximum(at, 0)], np.uint64(0))
    return (words.mix(packed) % np.uint64(CLASSES)).astype(np.int32)


def _count(batches):
    """Word counts of the whole partition, with the words' classes; kept small by merging."""
    held: list[tuple] = []

    def merge():
        word, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, first, back = np.unique(word, return_index=True, return_inverse=True)
        held[:] = [(word, kind[first], np.bincount(back, weights=n).astype(np.int64))]

    texts, size = 0, 0
    for batch in batches:
        texts += batch.num_rows
        for block in words.blocks(batch.column("text")):
            found = words.find_words(block, words.SPACED)
            word, first, n = np.unique(words.hash_words(block, found), return_index=True, return_counts=True)
            held.append((word, endings(block, found)[first], n))
            size += len(word)
            if size > 3_000_000:
                merge()
                size = 0
    held.append((np.array([END], dtype=np.uint64), np.zeros(1, np.int32), np.array([texts])))
    merge()
    word, kind, n = held[0]
    kept = n > 0
    yield pa.RecordBatch.from_arrays([pa.array(word[kept].view(np.int64)), pa.array(kind[kept], pa.int32()),
                                      pa.array(n[kept], pa.int64())], names=["word", "kind", "n"])


@dataclass
class Lexicon:
    """What every task knows of the counts."""

    word: np.ndarray  # the resolved words, sorted
    count: np.ndarray
    rank: np.ndarray  # place among the head, or HEAD
    total: int  # N
    distinct: int  # V
    class_total: np.ndarray
    class_distinct: np.ndarray

    def symbol_totals(self) -> np.ndarray:
        """Training tokens by emitted symbol: head words, then classes."""
        head = np.zeros(HEAD)
        inside = self.rank < HEAD
        head[self.rank[inside]] = self.count[inside]
        return np.concatenate([head, self.class_total])


def build_lexicon(counts: DataFrame) -> Lexicon:
    """`counts` has word, kind and c."""
    # How many words have each count; the cut keeps at most RESOLVED words.
    spread = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c"))
    total, distinct, held, cut = 0, 0, 0, None
    for r in spread.toLocalIterator():
        total, distinct = total + r.c * r.n, distinct + r.n
        if held + r.n <= RESOLVED and (cut is None or cut > 0):
            held, cut = held + r.n, r.c
        elif cut is None or cut > 0:
            cut = -(cut or r.c + 1)  # closed
    cut = abs(cut) if cut is not None else 1
    found = counts.filter((F.col("c") >= cut) | (F.col("word") == END)).toArrow()
    word = found["word"].to_numpy().view(np.uint64)
    c, kind = found["c"].to_numpy(), found["kind"].to_numpy()
    order = np.argsort(word)
    word, c, kind = word[order], c[order], kind[order]
    best = np.lexsort((word, -c, word != END))[:HEAD]
    rank = np.full(len(word), HEAD, dtype=np.int32)
    rank[best] = np.arange(len(best))
    # Class totals leave the head words out.
    whole = counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    class_total[whole["kind"].to_numpy()] = whole["c"].to_numpy()
    class_distinct[whole["kind"].to_numpy()] = whole["v"].to_numpy()
    np.subtract.at(class_total, kind[best], c[best])
    np.subtract.at(class_distinct, kind[best], 1)
    return Lexicon(word, c.astype(np.float64), rank, int(total), int(distinct), class_total, class_distinct)


def _encode(shared):
    """Symbols of each text, sums over the tokens whose counts are known here, and the words still to look up."""

    def encode(batches):
        lexicon = shared.value
        base = np.log10(lexicon.total + lexicon.distinct + 1)
        with np.errstate(divide="ignore"):
            unknown = np.log10(DISCOUNT * lexicon.class_distinct)
            share = -np.log10(lexicon.class_total)
        unknown[lexicon.class_total <= 0] = 0.0
        share[lexicon.class_total <= 0] = 0.0
        end = np.flatnonzero(lexicon.word == END)
        end_count = float(lexicon.count[end[0]]) if len(end) else 0.0
        for batch in batches:
            rows = {k: [] for k in ("symbols", "n_tokens", "n_known", "base_part", "word_part", "rest")}
            for block in words.blocks(batch.column("text")):
                found = words.find_words(block, words.SPACED)
                h = words.hash_words(block, found)
                kind = endings(block, found)
                at = np.searchsorted(lexicon.word, h)
                at[at == len(lexicon.word)] = 0
                known = lexicon.word[at] == h if len(lexicon.word) else np.zeros(len(h), dtype=bool)
                c = np.where(known, lexicon.count[at], 0) if len(lexicon.word) else np.zeros(len(h))
                rank = np.where(known, lexicon.rank[at], HEAD) if len(lexicon.word) else np.full(len(h), HEAD)
                tail = rank == HEAD
                symbols = np.where(tail, HEAD + kind, rank).astype(np.uint16)
                base_part = np.where(known, np.log10(c + 1), 0.0) - base
                word_part = np.where(tail, share[kind], 0.0)
                counted = known & tail
                word_part[counted] += np.log10(c[counted] - DISCOUNT)
                sums = np.append(0, np.cumsum(base_part)), np.append(0, np.cumsum(word_part)), np.append(0, np.cumsum(known))
                missing = np.flatnonzero(~known)
                cuts = found.cuts.tolist()
                parts = np.searchsorted(missing, found.cuts).tolist()
                for i in range(len(cuts) - 1):
                    lo, hi = cuts[i], cuts[i + 1]
                    rows["symbols"].append(np.append(symbols[lo:hi], np.uint16(0)).tobytes())
                    rows["n_tokens"].append(hi - lo + 1)
                    rows["n_known"].append(int(sums[2][hi] - sums[2][lo]) + (end_count > 0))
                    rows["base_part"].append(float(sums[0][hi] - sums[0][lo] + np.log10(end_count + 1) - base))
                    rows["word_part"].append(float(sums[1][hi] - sums[1][lo]))
                    m = missing[parts[i]:parts[i + 1]]
                    rows["rest"].append([{"word": w, "unknown": u} for w, u in zip(
                        h[m].view(np.int64).tolist(), unknown[kind[m]].tolist(), strict=True)])
            rest = pa.list_(pa.struct([("word", pa.int64()), ("unknown", pa.float64())]))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), batch.column("held_out"),
                 *[pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]],
                names=["uid", "doc_id", "held_out", *rows])

    return encode


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states
    overall: np.ndarray  # share of tokens by state

    def counts(self, sequences: list[np.ndarray]):
        """Expected counts (start, move, emit) of the sequences, cut into segments."""
        k = len(self.start)
        first, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        pieces = [(s[i:i + SEGMENT], i == 0) for s in sequences for i in range(0, len(s), SEGMENT)]
        pieces.sort(key=lambda p: -len(p[0]))
        for lo in range(0, len(pieces), CHUNK):
            part = pieces[lo:lo + CHUNK]
            lengths = np.array([len(p) for p, _ in part])
            steps, rows = int(lengths[0]), len(part)
            symbols = np.zeros((steps, rows), dtype=np.int64)
            for j, (p, _) in enumerate(part):
                symbols[:len(p), j] = p
            active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # longer than t
            opens = np.array([o for _, o in part])
            likely = self.emit[symbols]
            alpha = np.zeros((steps, rows, k))
            scale = np.ones((steps, rows))
            a = np.where(opens[:, None], self.start, self.overall) * likely[0]
            for t in range(steps):
                n = active[t]
                if t:
                    a = (alpha[t - 1, :n] @ self.move) * likely[t, :n]
                scale[t, :n] = a.sum(axis=1)
                alpha[t, :n] = a / scale[t, :n, None]
            beta = np.ones((rows, k))
            for t in range(steps - 1, -1, -1):
                n = active[t]
                if t + 1 < steps and active[t + 1]:
                    m = active[t + 1]
                    ahead = likely[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
                    moved += self.move * (alpha[t, :m].T @ ahead)
                    beta[:m] = ahead @ self.move.T
                alpha[t, :n] *= beta[:n]  # now the states' posterior
            first += alpha[0][opens].sum(axis=0)
            real = np.arange(steps)[:, None] < lengths
            at, gamma = symbols[real], alpha[real]
            for s in range(k):
                emitted[:, s] += np.bincount(at, weights=gamma[:, s], minlength=len(emitted))
        return first, moved, emitted

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of symbols, by the scaled forward recursion."""
        out = np.zeros(len(sequences))
        short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
        short.sort(key=lambda i: -len(sequences[i]))
        for i, s in enumerate(sequences):
            if len(s) > LONG:
                out[i] = self._long(s)
        if not short:
            return out
        lengths = np.array([len(sequences[i]) for i in short])
        flat = np.concatenate([sequences[i] for i in short]).astype(np.int64)
        offset = np.append(0, np.cumsum(lengths))[:-1]
        a = np.tile(self.start, (len(short), 1))
        total = np.zeros(len(short))
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
        for t, n in enumerate(active):
            a = (a[:n] if t == 0 else a[:n] @ self.move) * self.emit[flat[offset[:n] + t]]
            scale = a.sum(axis=1)
            total[:n] += np.log10(scale)
            a /= scale[:, None]
        out[short] = total
        return out

    def _long(self, symbols: np.ndarray, width: int = 512) -> float:
        k = len(self.start)
        symbols = symbols.astype(np.int64)
        a = self.start * self.emit[symbols[0]]
        total = float(np.log10(a.sum()))
        a /= a.sum()
        rest = symbols[1:]
        whole = len(rest) // width * width
        blocks = rest[:whole].reshape(-1, width)
        for lo in range(0, len(blocks), 4096):
            part = blocks[lo:lo + 4096]
            m = np.tile(np.eye(k), (len(part), 1, 1))  # row j: from state j
            scale = np.zeros((len(part), k))
            for t in range(width):
                m = (m @ self.move) * self.emit[part[:, t]][:, None, :]
                s = m.sum(axis=2)
                scale += np.log10(s)
                m /= s[:, :, None]
            for matrix, s in zip(m, scale, strict=True):
                top = s.max()
                a = (a * 10.0 ** (s - top)) @ matrix
                total += float(np.log10(a.sum())) + float(top)
                a /= a.sum()
        for x in rest[whole:].tolist():
            a = (a @ self.move) * self.emit[x]
            total += float(np.log10(a.sum()))
            a /= a.sum()
        return total


def maximise(first: np.ndarray, moved: np.ndarray, emitted: np.ndarray, unigram: np.ndarray) -> Hmm:
    """The model of expected counts, with a little mass from the plain distribution of symbols."""
    start = (first + 0.1) / (first + 0.1).sum()
    move = (moved + 0.1) / (moved + 0.1).sum(axis=1, keepdims=True)
    emit = (emitted + PRIOR * unigram[:, None]) / (emitted.sum(axis=0) + PRIOR)
    share = emitted.sum(axis=0) + 1e-3
    return Hmm(start, move, emit, share / share.sum())


def _group_counts(batches):
    """Tokens of the partition by symbol, in a column for each group of texts; a text goes by its first symbol."""
    counts = np.zeros((GROUPS, HEAD + CLASSES), dtype=np.int64)
    for batch in batches:
        for b in batch.column("symbols").to_pylist():
            symbols = np.frombuffer(b, dtype=np.uint16)
            at, n = np.unique(symbols, return_counts=True)
            counts[int(symbols[0]) % GROUPS, at] += n
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(g[used]) for g in counts]],
                                     names=["at", *[f"g{g}" for g in range(GROUPS)]])


def group_counts(learned: DataFrame) -> np.ndarray:
    """Tokens of all texts of `learned` (symbols), symbols x groups."""
    names = [f"g{g}" for g in range(GROUPS)]
    counts = learned.select("symbols").mapInArrow(_group_counts, "at int, " + ", ".join(f"{g} long" for g in names))
    table = counts.groupBy("at").agg(*[F.sum(g).alias(g) for g in names]).toArrow()
    found = np.zeros((HEAD + CLASSES, GROUPS))
    if table.num_rows:
        found[table["at"].to_numpy()] = np.stack([table[g].to_numpy() for g in names], axis=1)
    return found


def joined_groups(counts: np.ndarray, states: int) -> np.ndarray:
    """Symbols x states: groups joined pair by pair, always the pair whose common distribution costs least likelihood."""
    def likelihood(v):
        used = v[v > 0]
        return float((used * np.log(used)).sum() - used.sum() * np.log(used.sum())) if len(used) else 0.0

    groups = {g: counts[:, g] for g in range(counts.shape[1]) if counts[:, g].any()}
    alone = {g: likelihood(v) for g, v in groups.items()}
    cost = {(x, y): alone[x] + alone[y] - likelihood(groups[x] + groups[y]) for x in groups for y in groups if x < y}
    while len(groups) > states:
        x, y = min(cost, key=lambda pair: (cost[pair], pair))
        groups[x] = groups[x] + groups.pop(y)
        alone[x] = likelihood(groups[x])
        cost = {pair: c for pair, c in cost.items() if y not in pair}
        for z in groups:
            if z != x:
                cost[min(x, z), max(x, z)] = alone[x] + alone[z] - likelihood(groups[x] + groups[z])
    emitted = np.zeros((len(counts), states))
    for s, g in enumerate(sorted(groups)):
        emitted[:, s] = groups[g]
    return emitted


def _expect(shared):
    """Expected counts of the partition: a row for each symbol used, and rows for starts and moves."""

    def expect(batches):
        model = shared.value
        total = None
        for batch in batches:
            sequences = [np.frombuffer(b, dtype=np.uint16) for b in batch.column("symbols").to_pylist()]
            got = model.counts(sequences)
            total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
        if total is None:
            return
        first, moved, emitted = total
        used = np.flatnonzero(emitted.any(axis=1))
        k = len(first)
        at = np.concatenate([used, -1 - np.arange(k), [-1 - k]])
        rows = np.concatenate([emitted[used], moved, first[None]])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(rows[:, s]) for s in range(k)]],
                                         names=["at", *[f"s{s}" for s in range(k)]])

    return expect


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES) -> Hmm:
    """Baum-Welch over all training texts."""
    spark = encoded.sparkSession
    learned = encoded.filter(~F.col("held_out")).select("symbols")
    model = maximise(np.zeros(states), STAY * np.eye(states), joined_groups(group_counts(learned), states), unigram)
    columns = [f"s{s}" for s in range(states)]
    for _ in range(ITERATIONS):
        sums = learned.mapInArrow(
            _expect(spark.sparkContext.broadcast(model)), "at int, " + ", ".join(f"{c} double" for c in columns))
        table = sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        if not table.num_rows:
            break
        at = table["at"].to_numpy()
        values = np.stack([table[c].to_numpy() for c in columns], axis=1)
        emitted, moved = np.zeros((len(unigram), states)), np.zeros((states, states))
        emitted[at[at >= 0]] = values[at >= 0]
        inner = (at < 0) & (at >= -states)
        moved[-1 - at[inner]] = values[inner]
        model = maximise(values[at == -1 - states][0], moved, emitted, unigram)
    return model


def _forward(shared):
    def forward(batches):
        model = shared.value
        for batch in batches:
            sequences = [np.frombuffer(b, dtype=np.uint16) for b in batch.column("symbols").to_pylist()]
            names = [n for n in batch.schema.names if n != "symbols"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(model.log10(sequences), pa.float64())], names=[*names, "symbol_part"])

    return forward


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text).

    `held_out` is a column expression; rows where it is false are learned from.
    """
    spark = docs.sparkSession
    storage.bounded_batches(docs)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count, "word long, kind int, n long")
    counts = storage.staged(counted.groupBy("word", "kind").agg(F.sum("n").alias("c")), "counts")
    lexicon = build_lexicon(counts)
    unigram = lexicon.symbol_totals() + 0.5
    unigram /= unigram.sum()
    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"uid long, doc_id {ident}, held_out boolean, symbols binary, n_tokens long, n_known long, base_part double, "
              "word_part double, rest array<struct<word: long, unknown: double>>")
    # The row number is made and stored in one pass, so it holds for the branches below.
    encoded = storage.staged(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(
        _encode(spark.sparkContext.broadcast(lexicon)), schema), "encoded")
    model = train(encoded, unigram)
    looked = encoded.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.unknown")
    looked = looked.join(counts.select("word", "c"), "word", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNull(), F.col("unknown")).otherwise(F.log10(F.col("c") - DISCOUNT))).alias("more_word"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more_base"), F.count("c").alias("more_known"))
    scored = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base_part", "word_part", "symbols").mapInArrow(
        _forward(spark.sparkContext.broadcast(model)),
        f"uid long, doc_id {ident}, held_out boolean, n_tokens long, n_known long, base_part double, word_part double, symbol_part double")
    zero = F.lit(0.0)
    return scored.join(looked, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("symbol_part") + F.col("word_part") + F.coalesce("more_word", zero)).alias("score"))


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = storage.table(spark, folder, "documents").select("doc_id", "text")
    return score_texts(docs, fold(F.col("doc_id"), 7) == 2)
