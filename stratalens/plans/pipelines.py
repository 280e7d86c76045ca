"""Whole analyses composed of operators. Each returns DataFrames by name; nothing runs ahead but what must
be materialised: the pairs table and the rank rounds, and in ``analyze`` the small tables that several results start from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators import churn as ch
from ..operators import graph, hotspots, rank, tags as tg, text, tree, usage
from ..session import cut_lineage
from ..sources.files import file_counts
from ..sources.results import summary_documents
from ..sources.rules import Rule


def repo_map(tags: DataFrame) -> dict[str, DataFrame]:
    """Everything that follows from the tags: ranks, graph listings and symbol tree."""
    pairs = graph.keep_pairs(tags)
    ranks = rank.rank_files(pairs)
    symbols = tg.file_symbols(tags)
    nodes = tree.symbol_tree(symbols)
    return {
        "ranks": ranks,
        "ranked_files": rank.ranked_files(ranks),
        "nodes": rank.node_listing(ranks),
        "edges": graph.edge_listing(pairs),
        "sizes": graph.graph_sizes(pairs),
        "symbols": symbols,
        "tree": nodes,
        "symbol_totals": tree.symbol_totals(nodes),
    }


def churn_report(
    commit_files: DataFrame,
    as_of: dt.date | str,
    months: int = 6,
    k: int | None = ch.TOP_FILES,
    repos: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Window label, file count and churn table of each repository."""
    window = ch.history_window(commit_files, as_of, months)
    return {
        "churn_totals": ch.churn_totals(window, as_of, months, repos),
        "churn": ch.churn_files(window, k),
    }


def process_table(
    commit_files: DataFrame, as_of: dt.date | str, months: int = 6, k: int | None = ch.TOP_PROCESS_FILES
) -> DataFrame:
    return ch.process_metrics(ch.history_window(commit_files, as_of, months), k)


def ranked_tag_list(source_files: DataFrame, rules: list[Rule] | None = None, **tagging) -> DataFrame:
    """Source files to the ordered list of ranked tags.

    Text is read twice, once for all tags, which go straight into the pairs table, and once for definitions;
    the tags themselves, most of them references, are never stored.
    """
    pairs = graph.keep_pairs(tg.tag_files(source_files, rules, **tagging))
    definitions = tg.tag_definitions(source_files, rules, **tagging)
    return rank.in_tag_order(rank.ranked_tags(definitions, pairs, rank.rank_files(pairs)))


def repo_map_blocks(source_files: DataFrame, rules: list[Rule] | None = None, **tagging) -> DataFrame:
    """Source files to the repository map text, one block per file of the graph: definitions below the heads around them.

    Text is read once: tags, definitions with their lines and heads, are kept as a row for each file.
    """
    hits = cut_lineage(tg.file_hits(source_files, rules, with_text=True, with_scopes=True, **tagging))
    pairs = graph.keep_pairs(tg.tags_of_hits(hits))
    definitions = tg.tags_of_hits(hits, "def")
    return text.repo_map_text(text.repo_map_lines(definitions, pairs), graph.file_degrees(pairs))


def analyze(
    tags: DataFrame,
    commit_files: DataFrame,
    repos: DataFrame,
    as_of: dt.date | str,
    months: int = 6,
    files: DataFrame | None = None,
    k: int | None = ch.TOP_FILES,
    match: str = hotspots.SUFFIX,
) -> dict[str, DataFrame]:
    """All results of an analysis for the repositories in ``repos(repo_id, repo_url, repo_name)``.

    Each of them has a row in ``summary``, ``churn_totals`` and ``summary_documents``, also one without tags or history.
    ``k`` is the length of the churn table, None for all files, and ``match`` how ranked files find their churn rows.
    ``files`` is a listing or manifest with one row per file; without it the files that have tags are counted.
    """
    listing = tags.select("repo_id", "path").distinct() if files is None else files
    repos = cut_lineage(repos)
    results = {**repo_map(tags), **churn_report(commit_files, as_of, months, k, repos)}
    # Hotspots, matrix and summaries start from these: without a cut each would read tags and history again.
    results["churn"] = cut_lineage(results["churn"])
    results["tree"] = cut_lineage(results["tree"])
    results["symbol_totals"] = tree.symbol_totals(results["tree"])
    results["hotspots"] = hotspots.hotspots(results["ranked_files"], results["churn"], match, k)
    results["matrix"] = hotspots.prioritization_matrix(results["ranked_files"], results["churn"], match, k)
    results["summary"] = usage.run_summary(
        file_counts(listing),
        results["ranked_files"],
        results["sizes"],
        results["churn"],
        results["hotspots"],
        results["symbol_totals"],
        repos,
    )
    results["summary_documents"] = summary_documents(
        repos, results["summary"], results["churn_totals"], results["churn"]
    )
    return results


def admin_metrics(analyses: DataFrame, leads: DataFrame) -> dict[str, DataFrame]:
    """The operator's view of the usage log."""
    return {
        "totals": usage.usage_totals(analyses, leads),
        "recent": usage.recent_analyses(analyses, usage.RECENT_SHOWN),
        "popular": usage.popular_repos(analyses),
        "leads": usage.recent_leads(leads),
    }
