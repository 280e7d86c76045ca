"""Source files read from folders.

Spark's file sources leave out every file or folder whose name starts with ``_`` or ``.``, and empty files; for
source code that loses ``__init__.py`` and counts too little. Folders are therefore listed and read by small
functions inside Spark tasks: directories level by level, then contents, spread by size.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..session import cut_lineage
from .rules import EXTENSION_LANGUAGES, RULES, Rule

# Folders of version control data inside a repository.
VCS_FOLDER = r"(^|/)\.git/"

# Contents one task reads, and hands to Spark at a time.
TASK_BYTES = 256 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024

# Entries of a listing handed to Spark at a time.
ENTRIES = 10_000

_ENTRY = "location string, length bigint, is_folder boolean"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or a file, hdfs, gs, abfs or s3 address; s3a and s3n are names for s3."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def _list_folders(folder: str):
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(folder)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for location in batch["location"]:
                entries = system.get_file_info(fs.FileSelector(location, recursive=False))
                rows = [
                    (entry.path, entry.size or 0, entry.type == fs.FileType.Directory)
                    for entry in entries
                    # Linked folders are not followed.
                    if not (local and entry.type == fs.FileType.Directory and os.path.islink(entry.path))
                ]
                for at in range(0, len(rows), ENTRIES):
                    yield pd.DataFrame(rows[at : at + ENTRIES], columns=["location", "length", "is_folder"])

    return listed


def _read_contents(folder: str):
    columns = ["repo_id", "path", "content", "problem"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(folder)
        for batch in batches:
            held, size = [], 0
            for row in batch.itertuples(index=False):
                content, problem = None, None
                try:
                    with system.open_input_stream(row.location) as stream:
                        content = stream.read()
                except (FileNotFoundError, PermissionError) as error:
                    # Gone, or not ours to read: told apart from a failing store, which fails the task and is tried again.
                    problem = f"{type(error).__name__}: {error}"
                held.append((row.repo_id, row.path, content, problem))
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
            yield pd.DataFrame(held, columns=columns)

    return read


def list_files(
    spark: SparkSession, folder: str, repo_id: str | None = None, include_vcs: bool = True
) -> DataFrame:
    """(repo_id, path, length, location) of all files in a folder, empty ones included; a file lists itself.

    Without ``repo_id``, ``folder`` holds one sub-folder per repository, named by its id. Each round lists all
    directories of one depth in parallel, so a repository with very many directories is shared by all tasks.
    """
    system, base = file_system(folder)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        found = spark.createDataFrame([(info.path, info.size, False)], _ENTRY)
        base = os.path.dirname(info.path)
    else:
        open_folders = spark.createDataFrame([(base,)], "location string")
        levels = []
        while True:
            level = cut_lineage(open_folders.mapInPandas(_list_folders(folder), _ENTRY))
            levels.append(level.where(~F.col("is_folder")))
            open_folders = level.where("is_folder").select("location").repartition("location")
            if open_folders.isEmpty():
                break
        found = reduce(DataFrame.unionByName, levels)
    below = F.substring(F.col("location"), len(base.rstrip("/")) + 2, F.length("location"))
    if repo_id is None:
        inside = F.contains(below, F.lit("/"))
        found = found.where(inside).withColumns(
            {
                "repo_id": F.substring_index(below, "/", 1),
                "path": F.substring(below, F.instr(below, "/") + 1, F.length(below)),
            }
        )
    else:
        found = found.withColumns({"repo_id": F.lit(repo_id), "path": below})
    if not include_vcs:
        found = found.where(~F.rlike("path", F.lit(VCS_FOLDER)))
    return found.select("repo_id", "path", "length", "location")


def decode_text(raw: Column) -> Column:
    """Bytes as UTF-8 text; null when they are not valid UTF-8."""
    return F.try_validate_utf8(raw.cast("string"))


def _opened_files(
    spark: SparkSession,
    folder: str,
    repo_id: str | None,
    rules: list[Rule] | None,
    extensions: dict[str, str] | None,
    include_vcs: bool,
) -> DataFrame:
    """(repo_id, path, content, problem) of the files in a language that has rules."""
    langs = {rule.lang for rule in (RULES if rules is None else rules)}
    known = EXTENSION_LANGUAGES if extensions is None else extensions
    wanted = [ext for ext, lang in known.items() if lang in langs]
    listing = list_files(spark, folder, repo_id, include_vcs)
    listing = cut_lineage(listing.where(extension(F.col("path")).isin(wanted) & (F.col("length") > 0)))
    size, count = listing.agg(F.sum("length"), F.count("*")).first()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil((size or 0) / TASK_BYTES))
    return (
        listing.select("repo_id", "path", "location")
        .repartition(max(1, min(parts, count)), "location")
        .mapInPandas(_read_contents(folder), "repo_id string, path string, content binary, problem string")
    )


def read_source_files(
    spark: SparkSession,
    folder: str,
    repo_id: str | None = None,
    rules: list[Rule] | None = None,
    extensions: dict[str, str] | None = None,
    include_vcs: bool = False,
) -> DataFrame:
    """The source_files table of a folder, or of one file.

    Only files in a language that has rules are opened. Files that are empty or not UTF-8 are left out, as they give no
    tags, and so are those that are gone or denied (``unreadable_files`` names them). Any other error fails the job.
    """
    contents = _opened_files(spark, folder, repo_id, rules, extensions, include_vcs)
    return contents.select("repo_id", "path", decode_text(F.col("content")).alias("content")).where(
        F.length("content") > 0
    )


def unreadable_files(
    spark: SparkSession,
    folder: str,
    repo_id: str | None = None,
    rules: list[Rule] | None = None,
    extensions: dict[str, str] | None = None,
    include_vcs: bool = False,
) -> DataFrame:
    """(repo_id, path, problem) of the files that ``read_source_files`` leaves out because they cannot be opened."""
    opened = _opened_files(spark, folder, repo_id, rules, extensions, include_vcs)
    return opened.where(F.col("problem").isNotNull()).select("repo_id", "path", "problem")


def file_counts(files: DataFrame) -> DataFrame:
    """Files per repository, of a listing, manifest or source_files table."""
    return files.groupBy("repo_id").agg(F.count("*").alias("file_count"))


# Length of the pieces of text that requested names are looked up by.
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct pieces of ``GRAM`` characters; null for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    pieces = F.transform(starts, lambda start: F.substr(text, start, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(pieces))


def missing_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of ``wanted(repo_id, text)``, requested names, that no path of the repository holds.

    A text is compared only with the paths that hold the rarest of its pieces, so the work does not grow with names
    times files. Texts shorter than a piece, which most paths hold, are compared with each path of their repository. A
    null text is held by none.
    """
    asked = wanted.select("repo_id", "text").distinct()
    pieces = asked.select("repo_id", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    paths = files.select("repo_id", "path")
    postings = paths.select("repo_id", "path", F.explode(_grams(F.col("path"))).alias("gram")).join(
        pieces.select("repo_id", "gram").distinct(), ["repo_id", "gram"], "left_semi"
    )
    counts = postings.groupBy("repo_id", "gram").agg(F.count("*").alias("paths"))
    rarest = (
        pieces.join(counts, ["repo_id", "gram"], "left")
        .groupBy("repo_id", "text")
        .agg(F.min(F.struct(F.coalesce("paths", F.lit(0)).alias("paths"), "gram")).alias("rarest"))
        .where(F.col("rarest.paths") > 0)
        .select("repo_id", "text", "rarest.gram")
    )
    holds = F.contains(F.col("path"), F.col("text"))
    met = postings.join(rarest, ["repo_id", "gram"]).where(holds).select("repo_id", "text")
    short = asked.where(F.length("text") < GRAM)
    held = met.unionByName(paths.join(short, "repo_id").where(holds).select("repo_id", "text")).distinct()
    return wanted.join(held, ["repo_id", "text"], "left_anti")
