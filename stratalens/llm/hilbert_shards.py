"""Shards cut from a Hilbert order of several metadata columns, so that files can be skipped on each of them.

Each column is quantised to bins of equal depth, the bins of a row are a cell, and rows are sorted by the cell's index on
the Hilbert curve. Runs of that order, cut where the running bytes pass multiples of the mean, are the shards: a shard's
size differs from the mean by less than the largest row. Cells that follow each other on the curve are neighbours, so a
shard spans a small range in every column.

Native: built-in functions only. The table that is sorted and summed has no texts.

Defined results: null metadata is a value of its own and the smallest; a null text has no bytes; rows that tie, also fully
equal ones, keep separate slots; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, running_sums, store, whole_row

BITS = 8
ROW_BYTES = 16


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state of the Hilbert curve for each (state, corner), flattened.

    A state is (entry corner e, direction d), numbered e * dims + d. At each level the corner is turned into the curve's
    own frame, its Gray-code rank is the digit, and entry and direction of that sub-cube follow from the rank.
    """
    full = (1 << dims) - 1

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def turn_left(x: int, n: int) -> int:
        n %= dims
        return ((x << n) | (x >> (dims - n))) & full

    rank = {gray(i): i for i in range(1 << dims)}

    def trailing_ones(i: int) -> int:
        return 0 if i % 2 == 0 else 1 + trailing_ones(i >> 1)

    digits, states = [], []
    for entry in range(1 << dims):
        for direction in range(dims):
            for corner in range(1 << dims):
                w = rank[turn_left(corner ^ entry, dims - (direction + 1) % dims)]
                inner_entry = gray((w - 1) // 2 * 2) if w else 0
                inner_direction = 0 if w == 0 else trailing_ones(w if w % 2 else w - 1) % dims
                digits.append(w)
                states.append(
                    (entry ^ turn_left(inner_entry, direction + 1)) * dims + (direction + inner_direction + 1) % dims
                )
    return digits, states


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the Hilbert curve of ``2 ** bits`` cells a side."""
    dims = len(cells)
    digits, states = (F.lit(t) for t in curve_tables(dims))

    def step(state: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for i, cell in enumerate(cells):
            corner = corner + F.call_function("shiftright", cell, bit).bitwiseAND(1) * (1 << i)
        at = state["state"] * (1 << dims) + corner
        return F.struct(
            F.get(states, at).alias("state"),
            (state["index"] * (1 << dims) + F.get(digits, at)).alias("index"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["index"])


def quantise(rows: DataFrame, column: str, total: int, bits: int = BITS) -> DataFrame:
    """Add ``bin_<column>``: the share of rows with a smaller value, in ``2 ** bits`` steps. Equal values share a bin."""
    values = rows.groupBy(column).agg(F.count("*").alias("_n"))
    bins = running_sums(values, {"_before": F.col("_n")}, [column]).select(
        F.col(column).alias("_value"),
        F.expr(f"cast(_before * {1 << bits} div {max(total, 1)} as int)").alias(f"bin_{column}"),
    )
    return rows.join(bins, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def assign_shards(
    docs: DataFrame,
    shards: int,
    dims: tuple[str, ...] = ("lang", "source", "n_chars"),
    doc_id: str = "doc_id",
    text: str = "text",
    bits: int = BITS,
    row: str | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, the bins, curve, shard, slot: one row per row of ``docs``.

    ``row`` names a column of ``docs`` without repeats: it orders ties and comes first.
    """
    keys = [row] if row else []
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = store(
        docs.select(
            *keys,
            F.col(doc_id).alias("doc_id"),
            *(F.col(d).alias(d) for d in dims),
            (F.length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
        )
    )
    sums = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    binned = rows
    for d in dims:
        binned = quantise(binned, d, sums["n"], bits)
    cells = [F.col(f"bin_{d}") for d in dims]
    keyed = binned.withColumn("curve", curve_index(cells, bits)).drop(*dims)
    placed = store(
        running_sums(
            keyed, {"_bytes": F.col("size"), "_rows": F.lit(1)}, ["curve", "doc_id", "size", "text_crc32", *keys]
        ).withColumn(
            # the middle of the row decides, so that each cut is at the row border nearest to the even one
            "shard",
            F.least(F.expr(f"cast((2 * _bytes + size) * {shards} div {2 * max(sums['bytes'] or 1, 1)} as int)"), F.lit(shards - 1)),
        )
    )
    first = placed.groupBy("shard").agg(F.min("_rows").alias("_first"))
    return placed.join(first, "shard").select(
        *keys, "doc_id", "size", "text_crc32", *(f"bin_{d}" for d in dims), "curve", "shard", (F.col("_rows") - F.col("_first")).alias("slot")
    )


def write_shards(
    docs: DataFrame,
    shards: int,
    folder: str,
    dims: tuple[str, ...] = ("lang", "source", "n_chars"),
    doc_id: str = "doc_id",
    text: str = "text",
    **options,
) -> None:
    """Write ``docs`` as one Parquet folder per shard, rows in the order of the curve. Ids may be null or repeat. Folders are
    named by ``shard``, with underscores before it where ``docs`` has such a column."""
    keyed = store(docs.select(whole_row(docs).alias("_kept"), F.monotonically_increasing_id().alias("_row")))
    read = keyed.select("_row", *(F.col("_kept").getField(c).alias(c) for c in dict.fromkeys((doc_id, text, *dims))))
    places = assign_shards(read, shards, dims, doc_id, text, row="_row", **options).select("_row", "shard", "slot")
    ordered = keyed.join(places, "_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    name = free_name(docs, "shard")
    ordered.select("_kept.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(folder)
