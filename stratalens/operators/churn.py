"""Churn and contributor metrics per file over a window of history.

Input is the commit_files table. Rows without counts (binary files) do not take part.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import in_window, mean_of, period_label, ratio
from ..functions.positions import all_positions, top_positions

REPO_PATH = ["repo_id", "path"]
REPO_FILENAME = ["repo_id", "filename"]

# Row counts of the published tables.
TOP_FILES = 30
TOP_PROCESS_FILES = 21
CHART_FILES = 15

# An author of at most this many files of the repository is a minor one.
MINOR_FILES = 2
# An author of less than this share of a file's changed lines is a minor one of that file.
MINOR_SHARE = 0.05


def history_window(commit_files: DataFrame, as_of: dt.date | str, months: int) -> DataFrame:
    """Commits of the ``months`` calendar months up to ``as_of``; a plain range test that reaches the scan."""
    counted = F.col("added").isNotNull() & F.col("removed").isNotNull()
    return commit_files.where(in_window(F.col("commit_ts"), as_of, months) & counted)


def _by_author(window: DataFrame) -> DataFrame:
    """One row per (file, author): what all churn metrics are summed from."""
    return window.groupBy(*REPO_PATH, "author_email").agg(
        F.count("*").alias("commits"),
        F.sum("added").alias("added"),
        F.sum("removed").alias("removed"),
        F.max("added").alias("max_added"),
        F.max("removed").alias("max_removed"),
        F.max(F.struct("commit_ts", "commit_hash")).alias("latest"),
    )


def _is_author() -> Column:
    return F.col("author_email") != ""


# What is summed per (file, author), and how it is summed on per file.
_SUMS = {
    "commits": F.sum, "added": F.sum, "removed": F.sum, "max_added": F.max, "max_removed": F.max, "latest": F.max,
}


def _file_totals() -> list[Column]:
    return [
        *[total(name).alias(name) for name, total in _SUMS.items()],
        F.count_if(_is_author()).alias("total_contributor"),
        F.max(F.col("added") + F.col("removed")).alias("most_lines"),
    ]


def _file_metrics(totals: DataFrame, *more: str) -> DataFrame:
    added, removed = F.col("added").cast("bigint"), F.col("removed").cast("bigint")
    max_added, max_removed = F.col("max_added").cast("bigint"), F.col("max_removed").cast("bigint")
    total, commits = added + removed, F.col("commits")
    return totals.select(
        "repo_id",
        "filename",
        "commits",
        "total_contributor",
        F.round(mean_of(F.col("most_lines"), total) * 100, 2).alias("contributor_exp"),
        total.alias("total_churn"),
        (max_added + max_removed).alias("max_churn"),
        mean_of(total, commits, 2).alias("avg_churn"),
        added.alias("lines_added"),
        max_added.alias("max_lines_added"),
        mean_of(added, commits, 2).alias("avg_lines_added"),
        removed.alias("removed_lines"),
        max_removed.alias("max_lines_removed"),
        mean_of(removed, commits, 2).alias("avg_lines_removed"),
        "latest",
        *more,
    )


def file_churn(window: DataFrame) -> DataFrame:
    """All files of the window with their churn metrics; ``latest`` is the newest commit, for ordering."""
    totals = _by_author(window).groupBy("repo_id", F.col("path").alias("filename")).agg(*_file_totals())
    return _file_metrics(totals)


def file_churn_with_minors(window: DataFrame) -> DataFrame:
    """``file_churn`` with ``minor_contributor`` (see ``minor_contributors``), from one pass over the history.

    Each (file, author) row counts once for its file and once for its author. An author of few files then becomes a
    row for each of them, and a last sum per file brings these to the file's own row.
    """
    file = F.struct(F.lit(True).alias("is_file"), F.col("path").alias("key"))
    author = F.struct(F.lit(False).alias("is_file"), F.col("author_email").alias("key"))
    sides = F.when(_is_author(), F.array(file, author)).otherwise(F.array(file))
    summed = (
        _by_author(window)
        .select("*", F.explode(sides).alias("side"))
        .groupBy("repo_id", "side.is_file", "side.key")
        .agg(*_file_totals(), F.count("*").alias("files"), F.min("path").alias("first"), F.max("path").alias("last"))
    )
    is_file = F.col("is_file")
    few = F.when(F.col("files") <= MINOR_FILES, F.array_distinct(F.array("first", "last"))).otherwise(F.array().cast("array<string>"))
    names = [*_SUMS, "total_contributor", "most_lines"]
    rows = summed.select(
        "repo_id",
        F.explode(F.when(is_file, F.array("key")).otherwise(few)).alias("filename"),
        *[F.when(is_file, F.col(name)).alias(name) for name in names],
        F.when(is_file, 0).otherwise(1).alias("minor"),
    )
    totals = rows.groupBy(*REPO_FILENAME).agg(
        *[F.any_value(name, F.lit(True)).alias(name) for name in names], F.sum("minor").alias("minor_contributor")
    )
    return _file_metrics(totals, "minor_contributor")


def minor_contributors(window: DataFrame) -> DataFrame:
    """Per file, how many of its authors touched at most two files of the repository in the window.

    Such an author's files are its smallest and largest path, so one sum per author finds them; nothing is
    joined back, however many files other authors touched.
    """
    per_author = (
        _by_author(window)
        .where(_is_author())
        .groupBy("repo_id", "author_email")
        .agg(F.count("*").alias("files"), F.min("path").alias("first"), F.max("path").alias("last"))
        .where(F.col("files") <= MINOR_FILES)
    )
    return (
        per_author.select("repo_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("filename"))
        .groupBy(*REPO_FILENAME)
        .agg(F.count("*").alias("minor_contributor"))
    )


def _author_lines(window: DataFrame) -> DataFrame:
    lines = (F.col("added") + F.col("removed")).cast("bigint")
    return window.groupBy("repo_id", F.col("path").alias("filename"), "author_email").agg(F.sum(lines).alias("lines"))


def _contributors(author_lines: DataFrame, files: DataFrame) -> DataFrame:
    """Contributor metrics of ``files``, which bring their changed lines as ``file_lines``."""
    share = F.try_divide(F.col("lines").cast("double"), F.col("file_lines").cast("double"))
    return (
        author_lines.join(files.select(*REPO_FILENAME, "file_lines"), REPO_FILENAME)
        .groupBy(*REPO_FILENAME)
        .agg(
            F.count("*").alias("total_contributor"),
            F.count_if(share < MINOR_SHARE).alias("minor_by_share"),
            F.round(F.coalesce(F.max(share) * 100, F.lit(0.0)), 2).alias("contributor_exp"),
        )
    )


def contributor_experience(window: DataFrame) -> DataFrame:
    """Per file: contributors, those below 5 % of its changed lines, and the top author's share in percent."""
    author_lines = _author_lines(window)
    return _contributors(author_lines, author_lines.groupBy(*REPO_FILENAME).agg(F.sum("lines").alias("file_lines")))


def churn_order() -> list[Column]:
    """Most commits first; equal counts in log order, newest commit first."""
    return [F.desc("commits"), F.desc("latest.commit_ts"), F.desc("latest.commit_hash"), F.asc("filename")]


CHURN_COLUMNS = [
    "commits",
    "total_contributor",
    "minor_contributor",
    "contributor_exp",
    "total_churn",
    "max_churn",
    "avg_churn",
    "lines_added",
    "max_lines_added",
    "avg_lines_added",
    "removed_lines",
    "max_lines_removed",
    "avg_lines_removed",
]


def churn_files(window: DataFrame, k: int | None = TOP_FILES) -> DataFrame:
    """The ``k`` most committed files per repository (all when None), with ``position`` from 1."""
    churn = file_churn_with_minors(window)
    if k is None:
        picked = all_positions(churn, ["repo_id"], churn_order(), "position")
    else:
        picked = top_positions(churn, ["repo_id"], churn_order(), k, "position")
    return picked.select("repo_id", F.col("position").cast("int").alias("position"), "filename", *CHURN_COLUMNS)


def churn_totals(
    window: DataFrame, as_of: dt.date | str, months: int, repos: DataFrame | None = None
) -> DataFrame:
    """Window label and number of files with commits per repository; one without commits counts if ``repos`` has it."""
    totals = (
        window.groupBy("repo_id", "path")
        .agg(F.lit(1).alias("one"))
        .groupBy("repo_id")
        .agg(F.count("*").alias("total_files_with_commits"))
    )
    if repos is not None:
        totals = repos.select("repo_id").join(totals, "repo_id", "left").fillna(0, ["total_files_with_commits"])
    return totals.withColumn("period", period_label(as_of, months))


def process_metrics(window: DataFrame, k: int | None = TOP_PROCESS_FILES, churn: str = "net") -> DataFrame:
    """The second churn table, whose counts are per commit: lines of a commit are summed before max and mean.

    ``churn`` is ``net`` (added minus removed) or ``gross`` (added plus removed).
    """
    sign = {"net": -1, "gross": 1}[churn]
    commits = window.groupBy(*REPO_PATH, "commit_hash").agg(
        F.sum("added").cast("bigint").alias("added"),
        F.sum("removed").cast("bigint").alias("removed"),
        F.max("commit_ts").alias("commit_ts"),
    )
    commits = commits.withColumn("churn", F.col("added") + F.lit(sign) * F.col("removed"))
    files = (
        commits.groupBy("repo_id", F.col("path").alias("filename"))
        .agg(
            F.count("*").alias("commits"),
            F.sum("churn").alias("Total_churn"),
            F.max("churn").alias("Max_churn"),
            F.sum("added").alias("lines_added"),
            F.max("added").alias("max_lines_added"),
            F.sum("removed").alias("removed_lines"),
            F.max("removed").alias("max_lines_removed"),
            F.max(F.struct("commit_ts", "commit_hash")).alias("latest"),
        )
    )
    if k is None:
        picked = all_positions(files, ["repo_id"], churn_order(), "position")
    else:
        picked = top_positions(files, ["repo_id"], churn_order(), k, "position")
    picked = picked.withColumn("file_lines", F.col("lines_added") + F.col("removed_lines"))
    count = F.col("commits")
    return picked.join(_contributors(_author_lines(window), picked), REPO_FILENAME).select(
        "repo_id",
        F.col("position").cast("int").alias("position"),
        "filename",
        "commits",
        F.col("total_contributor").alias("Total_contributor"),
        F.col("minor_by_share").alias("Minor_contributor"),
        F.col("contributor_exp").alias("Contributor_exp"),
        "Total_churn",
        "Max_churn",
        mean_of(F.col("Total_churn"), count).alias("Avg_churn"),
        "lines_added",
        "max_lines_added",
        mean_of(F.col("lines_added"), count).alias("avg_lines_added_per_commit"),
        "removed_lines",
        "max_lines_removed",
        mean_of(F.col("removed_lines"), count).alias("avg_lines_removed_per_commit"),
    )


def find_file(metrics: DataFrame, text: str) -> DataFrame:
    """First row per repository, in table order, whose file name holds ``text``."""
    hits = metrics.where(F.contains(F.col("filename"), F.lit(text)))
    return top_positions(hits, ["repo_id"], [F.asc("position")], 1, "_hit").drop("_hit")


def churn_chart(churn: DataFrame, k: int = CHART_FILES) -> DataFrame:
    """The first ``k`` rows with each one's churn over the largest of them."""
    shown = churn.where(F.col("position") <= k).select("repo_id", "position", "filename", "total_churn")
    largest = shown.groupBy("repo_id").agg(F.max("total_churn").alias("_largest"))
    return shown.join(largest, "repo_id").select(
        "repo_id",
        "position",
        "filename",
        "total_churn",
        ratio(F.col("total_churn"), F.greatest("_largest", F.lit(1))).alias("bar"),
    )
