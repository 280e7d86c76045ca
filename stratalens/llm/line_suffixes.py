"""Removal of repeated runs of lines with a suffix array over line ids.

Every line with a word has an id, its MD5. The suffixes of all documents' id sequences are ranked by prefix doubling: equal
ids share a rank; after a round suffixes share a rank if their first 2, 4, 8, ... lines are equal, because both halves had
equal ranks. Ranks keep the order of the ids, so suffixes of equal rank are neighbours in the suffix array: they are its
intervals of a longest common prefix of at least that depth. A suffix whose rank nobody shares needs no further round and
leaves, so rounds shrink to the repeated part. Intervals of depth ``min_lines`` are the starts of repeated runs; every
suffix of one but the first in (doc_id, line) order begins a later copy, whose lines are removed. Runs longer than
``min_lines`` are covered by the intervals of their own suffixes. By default a run may be one line, so each line with a word
stays where it stands first and nowhere else; the deeper intervals then tell how long the runs are that recur.

Native: built-in functions only. Only ids and ranks are shuffled in the rounds, texts once at the end.

Defined results: lines without a word take no part and stay; a null text stays null; an empty text stays empty; fully
equal rows are one document and get the same result, rows of one id with different texts are told apart by the text;
a null id is the smallest; an empty table gives an empty table; other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sums, store, whole_row

MIN_LINES = 1
_KEY = ["doc", "twin"]
_PLACE = ["doc", "twin", "at"]


def _twin(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, twin, at (number among the lines with a word), line (number among all), id."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda l, i: F.struct(i.alias("line"), l.alias("body")))
    worded = F.filter(lines, lambda s: s["body"].rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.where(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("doc"), _twin(F.col(text)).alias("twin"), F.posexplode(worded).alias("at", "s"))
        .select(*_KEY, "at", F.col("s.line").alias("line"), F.unhex(F.md5("s.body")).alias("id"))
        .dropDuplicates([*_KEY, "at"])
    )


def _rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """doc, twin, at, rank of the rows whose ``keys`` other rows share; rank is the place of the keys in their order."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*_PLACE)).alias("first")).where("_n > 1")
    ranked = running_sums(groups, {"rank": F.lit(1)}, keys)
    return store(rows.join(ranked.drop("_n"), keys).select(*_KEY, "at", "rank", (F.struct(*_PLACE) != F.col("first")).alias("later")))


def _ahead(ranks: DataFrame, by: int) -> DataFrame:
    """doc, twin, at, ra, rb: ranks of suffixes and of those ``by`` lines on, where both are shared."""
    on = ranks.select(F.col("doc").alias("_d"), F.col("twin").alias("_t"), (F.col("at") - by).alias("_a"), F.col("rank").alias("rb"))
    same = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("twin") == F.col("_t")) & (F.col("at") == F.col("_a"))
    return ranks.withColumnRenamed("rank", "ra").join(on, same).select(*_KEY, "at", "ra", "rb")


def suffix_ranks(ids: DataFrame) -> list[tuple[int, DataFrame]]:
    """(depth, doc/twin/at/rank/later) for depths 1, 2, 4, ... down to where no two suffixes share a rank."""
    depth, ranks, levels = 1, _rank(ids, ["id"]), []
    while not ranks.isEmpty():
        levels.append((depth, ranks))
        ranks = _rank(_ahead(ranks, depth), ["ra", "rb"])
        depth *= 2
    return levels


def later_starts(levels: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame | None:
    """doc, twin, at of suffixes whose first ``min_lines`` lines also start earlier; None if there are none."""
    below = [(depth, ranks) for depth, ranks in levels if depth <= min_lines]
    if not below or 2 * below[-1][0] <= min_lines:
        return None
    depth, ranks = below[-1]
    if depth != min_lines:  # two overlapping halves make up any length in between
        ranks = _rank(_ahead(ranks, min_lines - depth), ["ra", "rb"])
    return ranks.where("later").select(*_KEY, "at")


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, twin, removed (sorted numbers of the lines to go), deepest: most lines, as a power of two, seen to recur at once."""
    ids = store(line_ids(docs, doc_id, text))
    levels = suffix_ranks(ids)
    starts = later_starts(levels, min_lines)
    if starts is None:
        return ids.where("false").select(*_KEY, F.array("line").alias("removed"), F.lit(1).alias("deepest"))
    covered = starts.select(*_KEY, F.explode(F.sequence(F.col("at"), F.col("at") + (min_lines - 1))).alias("at")).distinct()
    gone = ids.select(*_KEY, "at", "line").join(
        covered.select(F.col("doc").alias("_d"), F.col("twin").alias("_t"), F.col("at").alias("_a")),
        F.col("doc").eqNullSafe(F.col("_d")) & (F.col("twin") == F.col("_t")) & (F.col("at") == F.col("_a")),
        "left_semi",
    )
    deepest = None
    for depth, ranks in levels:
        level = ranks.where("later").select(*_KEY, F.lit(depth).alias("depth")).distinct()
        deepest = level if deepest is None else deepest.unionByName(level)
    both = gone.select(*_KEY, "line", F.lit(None).cast("int").alias("depth")).unionByName(
        deepest.select(*_KEY, F.lit(None).cast("int").alias("line"), "depth")
    )
    return (
        both.groupBy(*_KEY)
        .agg(F.array_sort(F.collect_list("line")).alias("removed"), F.max("depth").alias("deepest"))
        .where(F.size("removed") > 0)
    )


def keep_flags(removed: Column) -> Column:
    """For each line up to the last of ``removed``, a sorted list of numbers, whether it stays. Linear in the lines."""
    return F.flatten(
        F.transform(
            removed,
            lambda x, i: F.concat(
                F.array_repeat(F.lit(True), (x - F.coalesce(F.get(removed, i - 1), F.lit(-1)) - 1).cast("int")),
                F.array(F.lit(False)),
            ),
        )
    )


def dedup_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text", result: str = "_lines"
) -> DataFrame:
    """``docs`` with repeated runs gone from ``text``, plus ``result``, a name that none of its columns has: a struct of
    n_lines, n_removed, deepest."""
    gone = store(removed_lines(docs, min_lines, doc_id, text)).withColumnsRenamed({"doc": "_doc", "twin": "_twin"})
    row = F.col("_row")
    body = row.getField(text)
    same = row.getField(doc_id).eqNullSafe(F.col("_doc")) & (_twin(body) == F.col("_twin"))
    # The lists have no size bound, so the join is the same at every size: never a broadcast.
    joined = docs.select(whole_row(docs).alias("_row")).join(gone.hint("merge"), same, "left").withColumns(
        {"_all": F.split(body, "\n", -1), "_flags": keep_flags(F.col("removed"))}
    )
    kept = F.filter("_all", lambda _, i: F.coalesce(F.get("_flags", i), F.lit(True)))
    cleaned = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(kept, "\n"))
    counts = F.struct(
        F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("deepest", F.lit(0)).alias("deepest"),
    )
    return joined.select(
        *(cleaned.alias(c) if c == text else row.getField(c).alias(c) for c in docs.columns), counts.alias(result)
    )
