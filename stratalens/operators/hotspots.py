"""Hotspots and the prioritisation matrix: structural rank joined with churn.

Ranked files come as ``ranked_files`` gives them, churn rows as ``churn_files`` does. A file matches a churn
row when either path is a suffix of the other; the first such row in churn order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.paths import ends_either_way
from .churn import TOP_FILES

SUFFIX, EXACT = "suffix", "exact"

# Share of the maximum above which commits and rank count as high.
HIGH_SHARE = 0.3

# Names of the four quadrants.
HIGHEST_RISK = "highest risk"
FRAGILE = "fragile but isolated"
STABLE = "stable & central"
SAFE = "safe territory"

_MATCHED = ["commits", "total_churn"]


def match_top_churn(
    ranked: DataFrame, churn: DataFrame, how: str, k: int = TOP_FILES, per_repo_values: DataFrame | None = None
) -> DataFrame:
    """Attach to each ranked file the first of its repository's ``k`` churn rows that matches by suffix.

    The bounded churn rows of a repository travel as one row, with ``per_repo_values`` where given, so there is
    one join, it is one to one, and a repository's ranked files are never multiplied by its churn rows.
    """
    rows = churn.where((F.col("position") <= k) & (F.col("filename") != "")).select(
        "repo_id", F.struct("position", "filename", *_MATCHED).alias("row")
    )
    per_repo = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list("row")).alias("_rows"))
    kept = [*ranked.columns]
    if per_repo_values is not None:
        per_repo = per_repo.join(per_repo_values, "repo_id")
        kept += [c for c in per_repo_values.columns if c != "repo_id"]
    first = F.get(F.filter("_rows", lambda row: ends_either_way(F.col("file"), row["filename"])), F.lit(0))
    matched = (
        ranked.where(F.col("file") != "")
        .join(per_repo, "repo_id", "left" if how == "left" else "inner")
        .withColumn("_first", first)
        .select(*kept, *[F.col(f"_first.{c}").alias(c) for c in _MATCHED])
    )
    return matched if how == "left" else matched.where(F.col("commits").isNotNull())


def _lengths(paths: DataFrame, path: str) -> DataFrame:
    """(repo_id, _lengths): the lengths that occur among a repository's paths, at most as many as the longest has characters."""
    return paths.groupBy("repo_id").agg(F.array_sort(F.collect_set(F.length(path))).alias("_lengths"))


def _path_key(path: Column) -> Column:
    return F.xxhash64("repo_id", path)


def _suffix_keys(paths: DataFrame, path: str, lengths: DataFrame, shorter: bool) -> DataFrame:
    """``paths`` with ``_key``, one row for each of their suffixes that is as long as some path of the other side.

    With ``shorter`` the whole path is no suffix of itself.
    """
    size = F.length(path)
    fitting = F.filter("_lengths", lambda n: (n < size) if shorter else (n <= size))
    keys = F.transform(fitting, lambda n: _path_key(F.substring(path, size - n + 1, n)))
    return paths.join(lengths, "repo_id").withColumn("_key", F.explode(keys)).drop("_lengths")


def match_all_churn(ranked: DataFrame, churn: DataFrame, how: str) -> DataFrame:
    """The same for any number of churn rows.

    Suffixes of one side are looked up as whole paths of the other by a 64-bit hash, and only those of a length that
    occurs there. What is shuffled of a suffix is its hash and a number for the row it belongs to; the pairs that meet are
    then given their paths, and those that only share a hash are dropped.
    """
    numbered = _path_key(F.col("file")).alias("_file")
    files = ranked.where(F.col("file") != "").select("repo_id", "file", numbered)
    rows = churn.where(F.col("filename") != "").select("repo_id", "position", "filename", *_MATCHED)
    row_within_file = (
        _suffix_keys(files, "file", _lengths(rows, "filename"), shorter=False)
        .select("_key", "_file")
        .join(rows.select(_path_key(F.col("filename")).alias("_key"), "repo_id", "position"), "_key")
    )
    file_within_row = (
        _suffix_keys(rows, "filename", _lengths(files, "file"), shorter=True)
        .select("_key", "position")
        .join(files.select(F.col("_file").alias("_key"), "repo_id", "_file"), "_key")
    )
    met = row_within_file.select("repo_id", "_file", "position").unionByName(
        file_within_row.select("repo_id", "_file", "position")
    )
    first = (
        met.join(files, ["repo_id", "_file"])
        .join(rows, ["repo_id", "position"])
        .where(ends_either_way(F.col("file"), F.col("filename")))
        .groupBy("repo_id", "file")
        .agg(F.min(F.struct("position", *_MATCHED)).alias("row"))
        .select("repo_id", "file", *[F.col(f"row.{c}").alias(c) for c in _MATCHED])
    )
    return ranked.where(F.col("file") != "").join(first, ["repo_id", "file"], how)


def match_exact(ranked: DataFrame, churn: DataFrame, how: str) -> DataFrame:
    """Attach the churn row of the same path."""
    rows = churn.select("repo_id", F.col("filename").alias("file"), *_MATCHED)
    return ranked.where(F.col("file") != "").join(rows, ["repo_id", "file"], how)


def _match(
    ranked: DataFrame,
    churn: DataFrame,
    how: str,
    match: str,
    k: int | None,
    per_repo_values: DataFrame | None = None,
) -> DataFrame:
    if match == SUFFIX and k is not None:
        return match_top_churn(ranked, churn, how, k, per_repo_values)
    if match == SUFFIX:
        matched = match_all_churn(ranked, churn, how)
    else:
        matched = match_exact(ranked, churn if k is None else churn.where(F.col("position") <= k), how)
    return matched if per_repo_values is None else matched.join(per_repo_values, "repo_id")


def hotspots(
    ranked: DataFrame, churn: DataFrame, match: str = SUFFIX, k: int | None = TOP_FILES
) -> DataFrame:
    """Files that are both ranked and churned, with rank share times commit share as score.

    ``k`` is the number of churn rows per repository that take part; None means all of ``churn``.
    """
    rows = churn if k is None else churn.where(F.col("position") <= k)
    highest_rank = ranked.groupBy("repo_id").agg(F.max("pagerank_score").alias("_rank"))
    most_commits = rows.groupBy("repo_id").agg(F.max("commits").alias("_commits"))
    score = ratio(F.col("pagerank_score"), F.col("_rank")) * ratio(F.col("commits"), F.col("_commits"))
    return (
        _match(ranked, churn, "inner", match, k, highest_rank.join(most_commits, "repo_id"))
        .select(
            "repo_id",
            "file",
            "pagerank_score",
            "centrality",
            "commits",
            "total_churn",
            F.round(score, 4).alias("hotspot_score"),
            "rank_position",
        )
    )


def hotspot_order() -> list[Column]:
    """Highest score first, equal scores in rank order."""
    return [F.desc("hotspot_score"), F.asc("rank_position")]


def prioritization_matrix(
    ranked: DataFrame, churn: DataFrame, match: str = SUFFIX, k: int | None = TOP_FILES
) -> DataFrame:
    """All ranked files with their commits and churn (0 when unmatched), coordinates and quadrant."""
    points = _match(ranked, churn, "left", match, k).select(
        "repo_id",
        "file",
        F.col("pagerank_score").alias("pagerank"),
        F.coalesce("commits", F.lit(0)).alias("commits"),
        F.coalesce("total_churn", F.lit(0)).alias("churn"),
    )
    maxima = points.groupBy("repo_id").agg(
        F.greatest(F.max("commits"), F.lit(1)).alias("_commits"),
        F.max("pagerank").alias("_rank"),
        F.greatest(F.max("churn"), F.lit(1)).alias("_churn"),
    )
    highest = F.coalesce(F.nullif(F.col("_rank"), F.lit(0.0)), F.lit(1.0))
    churned = F.col("commits") > F.col("_commits") * HIGH_SHARE
    central = F.col("pagerank") > highest * HIGH_SHARE
    quadrant = (
        F.when(churned & central, HIGHEST_RISK).when(churned, FRAGILE).when(central, STABLE).otherwise(SAFE)
    )
    return points.join(maxima, "repo_id").select(
        "repo_id",
        "file",
        "pagerank",
        "commits",
        "churn",
        ratio(F.col("commits"), F.col("_commits")).alias("x"),
        ratio(F.col("pagerank"), highest).alias("y"),
        ratio(F.col("churn"), F.col("_churn")).alias("size"),
        quadrant.alias("quadrant"),
    )
