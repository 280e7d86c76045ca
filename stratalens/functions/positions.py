"""Positions within groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# monotonically_increasing_id holds the partition above bit 33 and the row number below it.
_ROW_BITS = 33


def top_positions(df: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in column ``name``.

    Spark cuts each task's rows to ``k`` per group before the shuffle (WindowGroupLimit), so a group that
    holds most of the table is no heavier than the others.
    """
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(name) <= k)


def all_positions(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Number all rows of each group from 1 in column ``name``; ``order`` must be total.

    A plain ``row_number`` would sort each group in a single task. Here the rows are range-sorted over the
    whole cluster, so a large group spreads over many partitions, and each row's number within its partition
    is shifted by the number of rows its group has in earlier partitions. Only one row per (group, partition)
    takes part in that last step.
    """
    row_id, part, row, first, before = "_row_id", "_part", "_row", "_first", "_before"
    in_order = df.orderBy(*by, *order).withColumn(row_id, F.monotonically_increasing_id())
    rows = cut_lineage(in_order).select(
        "*",
        F.shiftright(row_id, _ROW_BITS).alias(part),
        F.col(row_id).bitwiseAND((1 << _ROW_BITS) - 1).alias(row),
    )
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        rows.groupBy(*by, part)
        .agg(F.min(row).alias(first), F.count("*").alias("_rows"))
        .select(
            *by,
            part,
            (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col(first) + 1).alias(before),
        )
    )
    return (
        rows.join(spans, [*by, part])
        .withColumn(name, F.col(row) + F.col(before))
        .drop(row_id, part, row, before)
    )
