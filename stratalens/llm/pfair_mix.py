"""Mixing of sources to target weights as a Pfair schedule.

Each source's documents, in order of their id, are cut into blocks of equal bytes. With q of Q slots, the i-th block of a
source is released at slot floor((i - 1) Q / q) and due by slot ceil(i Q / q). Of the released blocks the one with the
earliest deadline takes the next slot. In any first t slots a source then has t q / Q blocks, give or take less than one.
After Q slots every source is where it began, so the schedule of Q slots, whose size has nothing to do with the data, holds
for all blocks: block b of a source lies b div q periods on. A source that has run out leaves its slots empty; no row is lost.

Native: built-in functions only; the schedule itself is one ``aggregate`` over a sequence of Q numbers.

Defined results: a null source is a source of its own; a null text has no bytes; rows that tie in id stay apart in any
order; an empty table gives no rows; other columns pass ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, running_sums, store, whole_row

BLOCK_BYTES = 1 << 16
SLOTS = 1000
ROW_BYTES = 16


def slot_counts(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """source, weight -> source, weight, number (from 1), q: whole slots of ``slots``, one at least, by largest remainder.

    There must be no more sources than slots; a mix has few sources, and each has one row here.
    """
    every = Window.orderBy(F.col("source").asc_nulls_first())
    whole = Window.partitionBy()
    share = (F.lit(slots) - F.count("*").over(whole)) * F.col("weight") / F.nullif(F.sum("weight").over(whole), F.lit(0))
    shared = sources.select(
        "source", "weight", F.row_number().over(every).alias("number"), F.coalesce(share, F.lit(0.0)).alias("share")
    )
    floors = shared.withColumn("base", 1 + F.floor("share"))
    left = F.lit(slots) - F.sum("base").over(whole)
    rest = Window.orderBy(F.desc(F.col("share") - F.floor("share")), "number")
    return floors.select(
        "source", "weight", "number", (F.col("base") + (F.row_number().over(rest) <= left).cast("long")).alias("q")
    )


def schedule(counts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """number, i (from 1), q, released, due, slot: the earliest-deadline-first order of one period."""
    lists = counts.agg(F.array_sort(F.collect_list(F.struct("number", "q"))).alias("all")).select(
        F.col("all.q").alias("q")
    )

    def released(q: Column, done: Column) -> Column:
        return F.floor(done * slots / q)

    def due(q: Column, done: Column) -> Column:
        return F.ceil((done + 1) * slots / q)

    def step(state: Column, t: Column) -> Column:
        waiting = F.transform(
            F.sequence(F.lit(0), F.size("q") - 1),
            lambda s: F.when(
                released(F.get("q", s), F.get(state["done"], s)) <= t,
                F.struct(due(F.get("q", s), F.get(state["done"], s)).alias("due"), s.alias("s")),
            ),
        )
        return F.struct(state["done"].alias("done"), state["out"].alias("out"), F.array_min(waiting).alias("pick"))

    def take(state: Column) -> Column:
        pick = state["pick"]["s"]
        return F.struct(
            F.transform(state["done"], lambda d, s: d + F.when(s == pick, 1).otherwise(0)).alias("done"),
            F.concat(state["out"], F.array(pick)).alias("out"),
        )

    start = F.struct(
        F.transform("q", lambda q: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("out")
    )
    order = F.aggregate(
        F.sequence(F.lit(0), F.lit(slots - 1)), start, lambda state, t: take(step(state, t)), lambda s: s["out"]
    )
    picks = lists.where(F.size("q") > 0).select("q", F.posexplode(order).alias("slot", "s"))
    nth = Window.partitionBy("s").orderBy("slot")
    q = F.get("q", F.col("s"))
    return picks.select(
        (F.col("s") + 1).alias("number"),
        F.row_number().over(nth).alias("i"),
        q.alias("q"),
        "slot",
    ).select(
        "number",
        "i",
        "q",
        F.floor((F.col("i") - 1) * slots / F.col("q")).alias("released"),
        F.ceil(F.col("i") * slots / F.col("q")).alias("due"),
        "slot",
    )


def interleave(
    docs: DataFrame,
    weights: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    slots: int = SLOTS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    row: str | None = None,
) -> DataFrame:
    """doc_id, source, size, block (of its source, from 0), released, due, slot: one row per row of ``docs``.

    ``weights`` has source and weight, each source once; one that it lacks gets the least share, a slot in each period.
    Without it a source weighs the square root of its bytes, which evens sizes out. ``slots`` is raised to four times the
    number of sources where that is more. ``row`` names a column of ``docs`` without repeats: it orders ties and comes first.
    """
    keys = [row] if row else []
    rows = store(
        docs.select(
            *keys,
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            (F.length(F.coalesce(F.col(text), F.lit("")).cast("binary")) + ROW_BYTES).cast("long").alias("size"),
        )
    )
    found = rows.groupBy("source").agg(F.sqrt(F.sum("size")).alias("weight"))
    if weights is not None:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("_weight"))
        found = found.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", F.coalesce("_weight", F.lit(0.0)).alias("weight")
        )
    weights = store(found)
    slots = max(slots, 4 * weights.count())
    counts = store(slot_counts(weights, slots))
    period = store(schedule(counts, slots))
    numbered = counts.select(F.col("source").alias("_source"), "number", "q")
    blocks = running_sums(rows, {"_before": F.col("size")}, ["doc_id", "size", *keys], ["source"]).withColumn(
        "block", F.expr(f"_before div {block_bytes}")
    )
    placed = blocks.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).withColumns(
        {"i": F.col("block") % F.col("q") + 1, "_period": F.expr("block div q")}
    )
    ahead = F.col("_period") * slots
    return placed.join(period.drop("q"), ["number", "i"]).select(
        *keys,
        "doc_id",
        "source",
        "size",
        "block",
        *((F.col(c) + ahead).alias(c) for c in ("released", "due", "slot")),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` in the order of the schedule: files written from it hold runs of slots, each mixed to the weights.

    Ids may be null or repeat: rows find their slots by a number of their own, stored so that it stays the same.
    """
    keyed = store(docs.select(whole_row(docs).alias("_kept"), F.monotonically_increasing_id().alias("_row")))
    read = [F.col("_kept").getField(c).alias(name) for c, name in ((doc_id, "doc_id"), (source, "source"), (text, "text"))]
    slots = store(
        interleave(keyed.select("_row", *read), row="_row", **options).select(
            F.col("_row").alias("_key"), F.col("doc_id").alias("_id"), F.col("slot").alias("_slot")
        )
    )
    joined = keyed.join(slots, F.col("_row") == F.col("_key"))
    order = ["_slot", "_id", "_row"]
    ordered = joined.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ordered.select("_kept.*")
