"""Approximate nearest neighbours by cosine from windows on several shifted Hilbert curves.

Every curve has a random projection to ``DIMS`` dimensions and a random shift. Vectors are sorted along each curve (range
partitions, sorted inside), and those that stand near a query on some curve are its candidates. The order is cut into blocks
as long as half a window, so a query meets the blocks before and after its own: a task gets one block of one curve with the
queries that look at it, compares them in double precision and keeps the best few; the best of all curves are the result.

The length of the windows is fitted: ``PILOTS`` queries are compared with all vectors, and the window reaches
``TARGET`` of their true neighbours on some curve. In structured data it stays short however many vectors there are; in
vectors without structure, where no order can tell near from far, it grows with them.

Equal vectors go through the index once, with their smallest ids; no neighbour list needs more of them than it is long.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do those whose
length is not the most frequent one (the longer on a tie) or whose id is null; ties go to the smaller id; with fewer
candidates than asked all are returned; rows repeated with their id count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sums, store

NEIGHBOURS = 5
CURVES = 32
DIMS = 8
BITS = 7
PILOTS = 64
TARGET = 0.96
LEAST_WINDOW = 128
_SEED = 7


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of integer cells (n, dims).

    From the top bit down, a set bit inverts the lower bits of the first axis, a clear one swaps them with those of the
    first axis; what is left is a Gray code of the index.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        lower = (1 << level) - 1
        for i, axis in enumerate(axes):
            is_set = (axis >> level) & 1 == 1
            swap = np.where(is_set, 0, (axes[0] ^ axis) & lower)
            axes[0] = axes[0] ^ np.where(is_set, lower, swap)
            if i:
                axes[i] = axis ^ swap
    index = np.zeros(len(cells), dtype=np.int64)
    parity = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            parity ^= (axis >> level) & 1
            index = index << 1 | parity
    return index


def projections(size: int, curves: int, dims: int) -> tuple[list[np.ndarray], np.ndarray]:
    """An orthonormal projection per curve, and its shift as a part of a cell's eighth of the range."""
    rng = np.random.default_rng(_SEED)
    bases = [np.linalg.qr(rng.normal(size=(size, min(dims, size))))[0] for _ in range(curves)]
    return bases, rng.random((curves, min(dims, size)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of rows with rows, in one order of summation wherever the rows stand."""
    dots = np.einsum("ij,ij->i", queries, vectors)
    return dots / (np.sqrt(np.einsum("ij,ij->i", queries, queries)) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors)))


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and cosine of the ``keep`` best vectors of each query."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rough = queries @ unit.T
    more = min(keep + 8, len(ids))
    near = np.argpartition(-rough, more - 1, axis=1)[:, :more] if more < len(ids) else np.tile(np.arange(len(ids)), (len(queries), 1))
    row = np.repeat(np.arange(len(queries)), near.shape[1])
    exact = _cosines(queries[row], vectors[near.ravel()])
    order = np.lexsort((ids[near.ravel()], -exact, row))
    place = np.arange(len(order)) - np.repeat(np.arange(len(queries)) * near.shape[1], near.shape[1])
    order = order[place < keep]
    return row[order], ids[near.ravel()][order], exact[order]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (doubles): rows that take part, once each."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes["n"] if sizes else 0))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """vector, rep (smallest id), ids (the ``keep`` smallest). Rows are cut to ``keep`` per vector before the shuffle."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= keep)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("rep", F.get("ids", F.lit(0)))


def _positions(index: DataFrame, size: int, curves: int, dims: int, bits: int) -> DataFrame:
    """curve, rep, place: the place of every vector on every curve."""
    bases, shifts = projections(size, curves, dims)
    reach = min(1.0, 4 / np.sqrt(size))
    cells = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for curve, (base, shift) in enumerate(zip(bases, shifts)):
                y = (x @ base + reach + shift * reach / 4) / (2.25 * reach)
                keys = curve_keys(np.clip(y * cells, 0, cells - 1).astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), curve, dtype=np.int32)), pa.array(keys), batch.column("rep")],
                    names=["curve", "key", "rep"],
                )

    keyed = index.select("rep", "vector").mapInArrow(run, "curve int, key long, rep long")
    return running_sums(keyed, {"place": F.lit(1)}, ["key", "rep"], ["curve"]).select("curve", "rep", "place")


def fitted_window(index: DataFrame, places: DataFrame, queries: DataFrame, pilots: int, target: float, k: int) -> int:
    """Half the window that reaches ``target`` of the true neighbours of a fixed number of queries."""
    sample = queries.orderBy(F.xxhash64("rep"), "rep").limit(pilots).collect()
    if not sample:
        return LEAST_WINDOW
    matrix = np.array([r["vector"] for r in sample])
    reps = np.array([r["rep"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, score = _best(matrix, _matrix(batch.column("vector")), batch.column("rep").to_numpy(), k + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps[row]), pa.array(ids), pa.array(score)], names=["query", "rep", "score"]
            )

    found = index.select("rep", "vector").mapInArrow(run, "query long, rep long, score double").where("query <> rep")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query", "rep")
    of_query = places.select(F.col("rep").alias("query"), "curve", F.col("place").alias("_at"))
    gaps = (
        near.join(places, "rep")
        .join(of_query, ["query", "curve"])
        .groupBy("query", "rep")
        .agg(F.min(F.abs(F.col("place") - F.col("_at"))).alias("gap"))
    )
    gap = gaps.agg(F.percentile("gap", F.lit(target)).alias("gap")).first()["gap"]
    return max(int(np.ceil(gap or 0)), LEAST_WINDOW)


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = NEIGHBOURS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = 50,
    curves: int = CURVES,
    dims: int = DIMS,
    bits: int = BITS,
    window: int | None = None,
    pilots: int = PILOTS,
    target: float = TARGET,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query. ``queries`` has ids of vectors, as vec_id;
    without it they are the ids divisible by ``every``. ``window`` is half the window; fitted if None."""
    rows = store(usable(vectors, vec_id, embedding))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0) if queries is None else rows.join(
        queries.select(F.col(vec_id).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"
    )
    index = store(_distinct(rows, k + 1))
    first = index.select(F.size("vector")).first()
    if first is None:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).where("false")
    named = store(asked.distinct().join(index.select("vector", "rep"), "vector").select(F.col("vec_id").alias("query_id"), "rep"))
    heads = index.join(named.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")
    places = store(_positions(index, first[0], curves, dims, bits))
    half = window or fitted_window(index, places, heads, pilots, target, k)

    blocks = places.select("curve", "rep", F.expr(f"place div {half}").alias("block"))
    looks = blocks.join(heads.select("rep"), "rep", "left_semi").select(
        "curve", "rep", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")
    )
    met = (
        blocks.withColumn("asks", F.lit(False))
        .unionByName(looks.withColumn("asks", F.lit(True)))
        .join(index.select("rep", "vector"), "rep")
    )

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, x = table["rep"].to_numpy(), _matrix(table["vector"].combine_chunks())
        if not asks.any() or asks.all():
            row, found, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
            query = row
        else:
            row, found, score = _best(x[asks], x[~asks], ids[~asks], k + 1)
            query = ids[asks][row]
        return pa.table([pa.array(query), pa.array(found), pa.array(score)], names=["query", "rep", "score"])

    candidates = (
        met.groupBy("curve", "block")
        .applyInArrow(compare, "query long, rep long, score double")
        .groupBy("query", "rep")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        candidates.join(index.select("rep", "ids"), "rep")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= k + 1)
        .drop("_n")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.join(store(lists), F.col("rep") == F.col("query"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
