"""Hashes of words and of windows of words, for numpy code inside tasks; texts packed for a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

# Odd 64-bit multipliers.
_POWER = 0x9E3779B97F4A7C15
_FINAL = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the input moves every bit of the result."""
    h = (h ^ (h >> np.uint64(32))) * _FINAL
    h = (h ^ (h >> np.uint64(29))) * _FINAL
    return h ^ (h >> np.uint64(32))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words; none if there are fewer words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(_POWER) + hashes[i : i + count]
    return mixed(total)


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words has one, of all of them."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(word_hashes(words), min(size, len(words))))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, empty for null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def packed_text(text: Column) -> Column:
    """Texts compressed one by one before they are shuffled: a fifth smaller than by the shuffle's own codec."""

    def run(column: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3)
        return pa.array([press.compress(t) for t in texts_of(column)], pa.binary())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(text)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    press = zstandard.ZstdDecompressor()
    for value in column:
        yield press.decompress(value.as_buffer())
