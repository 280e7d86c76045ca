"""The repository map as text: per file the source lines that hold its ranked definitions, below the heads that enclose them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import REPO_NAME, linked_names
from .tags import LINE_TEXT_LIMIT


def repo_map_lines(definitions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo_id, path, line, text) of definitions whose name is referred to in their repository, and of their enclosing heads.

    ``definitions`` must carry the line text (``with_text=True``), so source text is not joined back, and shows heads where it
    carries scopes (``with_scopes=True``).
    """
    linked = definitions.where(F.col("kind") == "def").join(linked_names(pairs), REPO_NAME, "left_semi")
    shown = F.array(F.struct("line", "text"))
    if "scopes" in definitions.columns:
        shown = F.concat(shown, "scopes")
    # Dealt out by file once: what is made of the lines of a file happens in place.
    return linked.select("repo_id", "path", F.inline(shown).alias("line", "text")).repartition("repo_id", "path").distinct()


def repo_map_text(lines: DataFrame, graph_files: DataFrame) -> DataFrame:
    """One text block per file of the graph: a heading, then its lines; files without lines get a bare heading.

    A block holds at most the lines of one source file, each cut to a fixed length. Spark cannot guess the size of blocks made
    from texts, so they are never broadcast.
    """
    blocks = lines.groupBy("repo_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_lines")
    )
    shown = F.array_join(F.transform("_lines", lambda row: row["text"]), "\n")
    heading = F.substring(F.concat(F.col("path"), F.lit(":")), 1, LINE_TEXT_LIMIT)
    files = graph_files.select("repo_id", F.col("file").alias("path"))
    return files.join(blocks.hint("merge"), ["repo_id", "path"], "left").select(
        "repo_id",
        "path",
        F.when(F.col("_lines").isNull(), F.substring("path", 1, LINE_TEXT_LIMIT))
        .otherwise(F.concat(heading, F.lit("\n"), shown))
        .alias("text"),
    )


def write_repo_map(blocks: DataFrame, folder: str) -> None:
    """Blocks as text, one folder per repository, files in name order."""
    blocks.orderBy("repo_id", "path").select("repo_id", F.concat(F.lit("\n"), "text").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("repo_id").text(folder)
