"""Hashed features of text batches, and small pieces that text classifiers share."""

import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from hourgrid.llm import words

_U = np.uint64


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text (null: empty text), modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(key, n: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % n


def byte_grams(block: words.Block, width: int, bits: int, values: np.ndarray, seed: int):
    """Buckets of all runs of `width` bytes inside each text, and the cuts between texts.

    `values` maps bytes before hashing (to fold case or classes).
    """
    n = len(block.data) - width + 1
    lengths = np.diff(block.bounds)
    per = np.maximum(lengths - width + 1, 0)
    cuts = np.append(0, np.cumsum(per))
    if n <= 0 or cuts[-1] == 0:
        return np.zeros(0, dtype=np.int64), cuts
    data = values[block.data].astype(np.uint64)
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        packed = (packed << _U(8)) | data[k:k + n]
    h = (packed + _U(seed)) * _U(0x9E3779B97F4A7C15)
    h = (h >> _U(64 - bits)).astype(np.int64)
    if len(lengths) > 1:  # leave out runs over the border of two texts
        keep = np.ones(n, dtype=bool)
        for k in range(1, width):
            at = block.bounds[1:-1] - k
            keep[at[(at >= 0) & (at < n)]] = False
        # A text shorter than the run may border on two others.
        h = h[keep]
    return h, cuts


def segment_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive cuts; empty segments give 0."""
    sums = np.append(np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64), axis=0)
    return sums[cuts[1:]] - sums[cuts[:-1]]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
