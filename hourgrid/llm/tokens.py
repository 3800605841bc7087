"""Token counts by a public tokenizer: lengths only, in Arrow batches.

Each text is cut at ASCII white space, where no token of the vocabulary and no step of its normaliser
reaches across. The distinct pieces of a batch are encoded by the library in sub-batches of even bytes, and a text's
count is the sum over its pieces. Short pieces seen before come from a table of bounded number, thus of bounded bytes. A piece longer than
`PIECE_BYTES` is cut further where a letter or digit is followed by a digit, or punctuation by a letter.

Cases: null and empty texts have no tokens. Repeated rows each get their row. Other columns are kept.
"""

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import storage

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
PIECE_BYTES = 1 << 16
BATCH_BYTES = 1 << 18
KNOWN_PIECES, KNOWN_BYTES = 400_000, 64  # pieces kept, and the longest of them
SAFE_CUT = re.compile(rb"(?<=[A-Za-z0-9])(?=[0-9])|(?<=[.,;:!?])(?=[A-Za-z0-9])")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _known(path: str) -> dict[bytes, int]:
    return {}


def short_parts(piece: bytes) -> list[bytes]:
    """A long piece cut at safe boundaries, each part at least `PIECE_BYTES` where cuts allow."""
    parts, at = [], 0
    while len(piece) - at > PIECE_BYTES:
        cut = SAFE_CUT.search(piece, at + PIECE_BYTES)
        if not cut:
            break
        parts.append(piece[at:cut.start()])
        at = cut.start()
    return [*parts, piece[at:]]


def encode_lengths(tokenizer, pieces: list[bytes]) -> list[int]:
    """Tokens of each piece, encoded in sub-batches of about `BATCH_BYTES`."""
    lengths, batch, held = [], [], 0
    for piece in pieces:
        batch.append(piece.decode())
        held += len(piece)
        if held >= BATCH_BYTES:
            lengths += [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
            batch, held = [], 0
    if batch:
        lengths += [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
    return lengths


def count_texts(texts: list[bytes], path: str) -> list[int]:
    tokenizer, known = _tokenizer(path), _known(path)
    split = [t.split() for t in texts]
    new = list({p for pieces in split for p in pieces if p not in known})
    short = [p for p in new if len(p) <= PIECE_BYTES]
    lengths = dict(zip(short, encode_lengths(tokenizer, short), strict=True))
    lengths |= {p: sum(encode_lengths(tokenizer, short_parts(p))) for p in new if len(p) > PIECE_BYTES}
    counts = [sum(lengths[p] if p in lengths else known[p] for p in pieces) for pieces in split]
    kept = [p for p in short if len(p) <= KNOWN_BYTES][:KNOWN_PIECES]
    if len(known) + len(kept) > KNOWN_PIECES:
        known.clear()
    known.update((p, lengths[p]) for p in kept)
    return counts


def _counter(text: str, path: str):
    def count(batches):
        for batch in batches:
            column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]) \
                if len(column) else np.zeros(0, dtype=np.int64)
            group = np.cumsum(sizes) // (8 << 20)  # texts handled at once
            counts: list[int] = []
            for g in np.unique(group).tolist():
                lo, hi = np.searchsorted(group, [g, g + 1]).tolist()
                counts += count_texts(column.slice(lo, hi - lo).to_pylist(), path)
            arrays = [batch.column(n) for n in batch.schema.names if n != text]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns of `docs` but the text, with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    Columns of those names are replaced. `path` is a tokenizer file every executor has.
    """
    storage.bounded_batches(docs)
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit") or c == text]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_counter(text, path), schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = storage.table(spark, folder, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY))
