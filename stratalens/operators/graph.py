"""The file dependency graph: who refers to a name that who defines.

A reference to a name points from the referring file to every file of the same repository that defines it.
Operators start from the pairs table, one row per (repository, name, file), which one pass over the tags gives.
The edge list, whose size is the product of referrers and definers of each name, is built only by
``dependency_edges`` for those who want it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import damping, ratio
from ..functions.positions import top_positions
from ..session import cut_lineage

REPO_NAME = ["repo_id", "name"]
REPO_FILE = ["repo_id", "file"]

# Referrers, and definers, of a name that meet in one cell of its product; parts in which rows find the cells of their name.
CELL_SIDE = 1000
SALTS = 64


def tag_pairs(tags: DataFrame) -> DataFrame:
    """``repo_id, name, path, ref_count, is_defined``: what each file does with each name.

    A name that dominates the tags is summed before the shuffle and then spread over its files.
    """
    return tags.groupBy("repo_id", "name", "path").agg(
        F.count_if(F.col("kind") == "ref").alias("ref_count"),
        F.max(F.col("kind") == "def").alias("is_defined"),
    )


def keep_pairs(tags: DataFrame) -> DataFrame:
    """``tag_pairs``, materialised, so that what follows reads neither tags nor text again."""
    return cut_lineage(tag_pairs(tags))


def definers(pairs: DataFrame) -> DataFrame:
    """Distinct (repo_id, name, path) of definitions."""
    return pairs.where("is_defined").select("repo_id", "name", "path")


def ref_counts(pairs: DataFrame) -> DataFrame:
    """References per (repo_id, name, path), as ``ref_count``.

    In a repository without any reference each definition stands for one reference to itself.
    """
    counted = pairs.where(F.col("ref_count") > 0).select("repo_id", "name", "path", "ref_count")
    have_refs = counted.select("repo_id").distinct()
    stand_ins = definers(pairs).join(have_refs, "repo_id", "left_anti").withColumn("ref_count", F.lit(1).cast("bigint"))
    return counted.unionByName(stand_ins)


def linked_names(pairs: DataFrame) -> DataFrame:
    """Distinct (repo_id, name) both defined and referred to.

    One sum by name; in a repository without any reference each definition stands for one.
    """
    names = pairs.groupBy(*REPO_NAME).agg(F.max("is_defined").alias("_defined"), F.max(F.col("ref_count") > 0).alias("_referred"))
    have_refs = pairs.groupBy("repo_id").agg(F.max(F.col("ref_count") > 0).alias("_have_refs"))
    return (
        names.where(F.col("_defined") & F.col("name").isNotNull())
        .join(have_refs, "repo_id")
        .where(F.col("_referred") | ~F.col("_have_refs"))
        .select(*REPO_NAME)
    )


def edge_weight() -> Column:
    return damping(F.col("name")) * F.sqrt(F.col("ref_count").cast("double"))


def dependency_edges(pairs: DataFrame) -> DataFrame:
    """One row per (name, referring file, defining file), self-references kept.

    The output is a product per name by definition. Both sides are grouped to one row per (name, file) before
    they meet. The product of a name with many files is cut into a grid of cells, ``CELL_SIDE`` referrers by as many
    definers or fewer, which are joined independently; a row goes to all cells of its line of the grid.
    """
    refs, defs = ref_counts(pairs), definers(pairs)
    grid = _grids(refs, defs)
    return _edges(_in_cells(refs, grid, "_row", "_column"), _in_cells(defs, grid, "_column", "_row"), [*REPO_NAME, "_row", "_column"])


def _grids(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(repo_id, name, _salt, _rows, _columns) of the names whose product needs more than one cell, once per salt."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = refs.select(*REPO_NAME, one.alias("r"), zero.alias("d")).unionByName(
        defs.select(*REPO_NAME, zero.alias("r"), one.alias("d"))
    )
    parts = lambda n: F.ceil(F.sum(n) / CELL_SIDE)
    return (
        both.groupBy(*REPO_NAME)
        .agg(parts("r").alias("_rows"), parts("d").alias("_columns"))
        .where("_rows > 0 and _columns > 0 and _rows + _columns > 2")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )


def _in_cells(side: DataFrame, grid: DataFrame, own: str, other: str) -> DataFrame:
    """``side`` with its line ``own`` of the grid, once for each line ``other``. Other names have one cell.

    Rows of a name that dominates look their grid up by name and salt, so that no task gets all of them.
    """
    path = F.xxhash64("path")
    lines = lambda c: F.coalesce(F.col(f"{c}s"), F.lit(1).cast("bigint"))
    return (
        side.withColumn("_salt", F.pmod(path, F.lit(SALTS)).cast("int"))
        .join(grid, [*REPO_NAME, "_salt"], "left")
        .withColumn(own, F.pmod(F.shiftrightunsigned(path, 8), lines(own)))
        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), lines(other) - 1)))
        .drop("_salt", "_rows", "_columns")
    )


def _edges(refs: DataFrame, defs: DataFrame, on: list[str] = REPO_NAME) -> DataFrame:
    return refs.join(defs.withColumnRenamed("path", "target"), on).select(
        "repo_id",
        F.col("path").alias("source"),
        "target",
        F.col("name").alias("ident"),
        edge_weight().alias("weight"),
    )


def edge_listing(pairs: DataFrame) -> DataFrame:
    """Edges with the weight at 4 decimals, as they are published."""
    return dependency_edges(pairs).withColumn("weight", F.round("weight", 4))


def linked_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two halves of the graph, restricted to names that are both defined and referred to.

    Returns ``refs(repo_id, name, path, ref_count, ...)`` and ``defs(repo_id, name, path, ...)``, both with the
    number of files on either half of their name: ``name_definers`` and ``name_referrers``.
    """
    refs, defs = ref_counts(pairs), definers(pairs)
    by_def = defs.groupBy(*REPO_NAME).agg(F.count("*").alias("name_definers"))
    by_ref = refs.groupBy(*REPO_NAME).agg(F.count("*").alias("name_referrers"))
    names = by_def.join(by_ref, REPO_NAME)
    return refs.join(names, REPO_NAME), defs.join(names, REPO_NAME)


def file_degrees(pairs: DataFrame) -> DataFrame:
    """Out- and in-degree per file of the graph, parallel edges counted, without building the edges.

    Names that nobody defines add to no degree. A name is one row, so pairs look it up by hash, unsorted.
    """
    names = pairs.groupBy(*REPO_NAME).agg(
        F.count_if(F.col("ref_count") > 0).alias("_referrers"), F.count_if("is_defined").alias("_definers")
    )
    total = lambda met, n: F.sum(F.when(met, F.col(n)).otherwise(0))
    files = (
        pairs.join(names.where("_definers > 0").hint("shuffle_hash"), REPO_NAME)
        .groupBy("repo_id", F.col("path").alias("file"))
        .agg(
            total(F.col("ref_count") > 0, "_definers").alias("_out"),
            total(F.col("is_defined"), "_referrers").alias("_in"),
            total(F.col("is_defined"), "_definers").alias("_own"),
        )
    )
    # In a repository without any reference each definition is one, so a name is referred to as often as it is defined.
    have_refs = pairs.groupBy("repo_id").agg(F.max(F.col("ref_count") > 0).alias("_have_refs"))
    degree = lambda n: F.when(F.col("_have_refs"), F.col(n)).otherwise(F.col("_own"))
    return (
        files.join(have_refs, "repo_id")
        .select(*REPO_FILE, degree("_out").alias("out_degree"), degree("_in").alias("in_degree"))
        .where((F.col("out_degree") > 0) | (F.col("in_degree") > 0))
    )


def degrees_of(refs: DataFrame, defs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    outgoing = refs.select("repo_id", F.col("path").alias("file"), F.col("name_definers").alias("o"), zero.alias("i"))
    incoming = defs.select("repo_id", F.col("path").alias("file"), zero.alias("o"), F.col("name_referrers").alias("i"))
    return (
        outgoing.unionByName(incoming)
        .groupBy(*REPO_FILE)
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    )


def graph_sizes(pairs: DataFrame) -> DataFrame:
    """Nodes and edges per repository."""
    return (
        file_degrees(pairs)
        .groupBy("repo_id")
        .agg(F.count("*").alias("graph_nodes"), F.sum("out_degree").alias("graph_edges"))
    )


def centrality_of(degrees: DataFrame) -> DataFrame:
    """Degree over the number of other nodes; 1 in a graph of one node. A self-reference counts twice."""
    nodes = degrees.groupBy("repo_id").agg(F.count("*").alias("_n"))
    share = (F.col("out_degree") + F.col("in_degree")).cast("double") / (F.col("_n") - 1)
    return degrees.join(nodes, "repo_id").select(
        *REPO_FILE, F.when(F.col("_n") > 1, share).otherwise(1.0).alias("centrality")
    )


def degree_centrality(pairs: DataFrame) -> DataFrame:
    return centrality_of(file_degrees(pairs))


def most_central(centrality: DataFrame) -> DataFrame:
    """The file of highest centrality per repository; on ties the first by name."""
    best = F.max("centrality").alias("centrality")
    top = centrality.groupBy("repo_id").agg(best)
    return (
        centrality.join(top, ["repo_id", "centrality"])
        .groupBy("repo_id", "centrality")
        .agg(F.min("file").alias("file"))
        .select(*REPO_FILE, "centrality")
    )


def top_nodes(ranks: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` nodes of highest published rank per repository (all when ``n`` is None), with display metrics.

    ``relative_rank`` is the rank over the highest one shown; it gives both size and colour.
    """
    nodes = ranks.select(*REPO_FILE, F.round("rank", 6).alias("pagerank"))
    if n is not None:
        order = [F.desc("pagerank"), F.asc("file")]
        nodes = top_positions(nodes, ["repo_id"], order, n, "_position").drop("_position")
    highest = nodes.groupBy("repo_id").agg(F.max("pagerank").alias("_highest"))
    return nodes.join(highest, "repo_id").select(
        *REPO_FILE, "pagerank", ratio(F.col("pagerank"), F.col("_highest")).alias("relative_rank")
    )


def subgraph_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``, self-references left out.

    The pair tables are cut to those files before they meet, so no edge is built only to be dropped.
    """
    kept = nodes.select("repo_id", F.col("file").alias("path")).distinct()
    refs = ref_counts(pairs).join(kept, ["repo_id", "path"], "left_semi")
    defs = definers(pairs).join(kept, ["repo_id", "path"], "left_semi")
    return _edges(refs, defs).where(F.col("source") != F.col("target"))


SHOWN_IDENTS = 5


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row per file pair: sum of the published weights and the first five names in order."""
    pair = ["repo_id", "source", "target"]
    # A name has one edge per pair. One sort by pair gives both the total and the first names.
    own = Window.partitionBy(*pair)
    numbered = edges.select(
        *pair,
        "ident",
        F.sum(F.round("weight", 4)).over(own).alias("weight"),
        F.row_number().over(own.orderBy("ident")).alias("_position"),
    )
    return (
        numbered.where(F.col("_position") <= SHOWN_IDENTS)
        .groupBy(*pair)
        .agg(F.max("weight").alias("weight"), F.array_sort(F.collect_list("ident")).alias("idents"))
    )
