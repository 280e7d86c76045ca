"""Packing by concatenating and cutting: all documents end to end, cut into sequences of a fixed length.

Two passes. The first tokenizes each document once and stores its ids, with the number of ids before it in its task.
Sums per task, a row each, give every task its global offset. The second pass reads the stored ids and cuts each document
where a sequence ends, so a document that crosses a boundary leaves a record in both sequences. No text is shuffled, and
the stored table fixes the order: a task that is run again reads the same rows.

Defined results: a null text is empty and gives its end id alone; repeated rows are packed each; an empty table gives no
pieces; only the last sequence is short; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SEQUENCE = 1024
END_ID = 0


class Encoder:
    """Ids of texts, as bytes of unsigned integers.

    ``path`` is the tokenizer's file and says what the ids are. ``ranks``, the same byte-level vocabulary as a rank file,
    gives the same ids four times as fast; a text that spells an added token is left to the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = dtype
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(token in text for token in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype=self.dtype).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None, dtype: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(path, ranks, dtype)


def _dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """task, before, doc_id, n, ids: before counts the ids of earlier documents of the same task. Stored."""
    dtype = _dtype(path)
    width = int(dtype[-1])
    end = np.array([END_ID], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, dtype)
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small steps bound what is held at once
                piece = batch.slice(at, 256)
                ids = [encode(t or "") + end for t in piece.column("text").to_pylist()]
                sizes = np.array([len(b) // width for b in ids], dtype=np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), task, dtype=np.int32)),
                        pa.array(starts),
                        piece.column("doc_id"),
                        pa.array(sizes),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["task", "before", "doc_id", "n", "ids"],
                )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return store(chosen.mapInArrow(run, "task int, before long, doc_id long, n long, ids binary"))


def pack(
    docs: DataFrame,
    path: str,
    ranks: str | None = None,
    length: int = SEQUENCE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (list of int)."""
    stored = tokenize(docs, path, ranks, doc_id, text)
    dtype = _dtype(path)
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("task").agg(F.sum("n").alias("ids_")).select(
        "task", F.coalesce(F.sum("ids_").over(earlier), F.lit(0).cast("long")).alias("offset_")
    )
    # A row of 12 bytes per task of the first pass: a million tasks are 12 MB.
    placed = stored.join(F.broadcast(offsets), "task").select(
        (F.col("before") + F.col("offset_")).alias("at"), "doc_id", "n", "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                yield _cut(batch.slice(first, 256), length, dtype)

    return placed.mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "ids array<int>",
    )


def _cut(batch: pa.RecordBatch, length: int, dtype: str) -> pa.RecordBatch:
    places = batch.column("at").to_numpy()
    sizes = batch.column("n").to_numpy()
    first = places // length
    pieces = (places + sizes - 1) // length - first + 1
    row = np.repeat(np.arange(len(places)), pieces)
    sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.maximum(places[row], sequence * length)
    stop = np.minimum((places + sizes)[row], (sequence + 1) * length)
    start = begin - places[row]
    every = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=dtype).astype("<u4")
    base = np.cumsum(sizes) - sizes
    low = base[row] + start
    high = low + (stop - begin)
    crcs = [zlib.crc32(every[a:b]) for a, b in zip(low.tolist(), high.tolist())]
    ids = pa.ListArray.from_arrays(pa.array(np.append(low, len(every)).astype(np.int32)), pa.array(every.astype(np.int32)))
    doc_ids = batch.column("doc_id").take(pa.array(row))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(start),
            pa.array(stop - begin),
            pa.array(np.array(crcs, dtype=np.int64)),
            pa.array(sizes[row]),
            pa.array(sequence),
            pa.array(begin - sequence * length),
            ids,
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
    )
