"""The directory tree of files with symbols, as flat rows.

Symbols are ``file_symbols`` rows. Tree rows are one per directory and per file; the symbols of a file stay rows
of their own, joined by path, so no row grows with a file's symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, forward_slashes, parent_path

DIRECTORY, FILE = "dir", "file"


def _file_counts(symbols: DataFrame) -> DataFrame:
    return (
        symbols.select("repo_id", forward_slashes(F.col("path")).alias("path"))
        .groupBy("repo_id", "path")
        .agg(F.count("*").alias("symbol_count"))
    )


def _node(path: Column, node_type: str) -> list[Column]:
    return [
        path.alias("path"),
        parent_path(path).alias("parent"),
        (F.size(F.split(path, "/")) - 1).alias("depth"),
        base_name(path).alias("name"),
        F.lit(node_type).alias("node_type"),
    ]


def symbol_tree(symbols: DataFrame) -> DataFrame:
    """One row per directory and file with the number of symbols in it or beneath it.

    Symbols are counted per file first; directories then sum those counts over their files.
    """
    files = _file_counts(symbols)
    path = F.col("path")
    directories = (
        files.select("repo_id", F.explode(ancestors(path)).alias("path"), "symbol_count")
        .groupBy("repo_id", "path")
        .agg(F.sum("symbol_count").alias("symbol_count"))
    )
    return directories.select("repo_id", *_node(path, DIRECTORY), "symbol_count").unionByName(
        files.select("repo_id", *_node(path, FILE), "symbol_count")
    )


def in_tree_order(tree: DataFrame) -> DataFrame:
    """Per directory its directories, then its files, each by name."""
    return tree.orderBy("repo_id", "parent", "node_type", "name")


def tree_files(tree: DataFrame) -> DataFrame:
    """The file rows of a tree."""
    return tree.where(F.col("node_type") == FILE)


def shown_nodes(tree: DataFrame) -> DataFrame:
    """Rows a viewer sees: files without symbols are hidden."""
    return tree.where((F.col("node_type") == DIRECTORY) | (F.col("symbol_count") > 0))


def symbol_totals(tree: DataFrame) -> DataFrame:
    """Files and symbols per repository."""
    return (
        tree_files(tree)
        .groupBy("repo_id")
        .agg(F.count("*").alias("total_files"), F.sum("symbol_count").alias("total_symbols"))
    )


def symbol_search(tree: DataFrame, symbols: DataFrame, text: str) -> DataFrame:
    """Tree rows that hold ``text``, ignoring case, in their own name, a symbol, or anything beneath them."""

    def holds(column: str) -> Column:
        return F.contains(F.lower(column), F.lower(F.lit(text)))

    by_name = tree.where(holds("name")).select("repo_id", "path")
    by_symbol = symbols.where(holds("name")).select("repo_id", forward_slashes(F.col("path")).alias("path")).distinct()
    found = by_name.unionByName(by_symbol).distinct()
    above = F.array_append(ancestors(F.col("path")), F.col("path"))
    kept = found.select("repo_id", F.explode(above).alias("path")).distinct()
    return tree.join(kept, ["repo_id", "path"], "left_semi")
