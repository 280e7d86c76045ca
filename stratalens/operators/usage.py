"""The usage log: requests, analyses and leads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import cache_key, clean_url, is_repo_url, repo_name, repo_owner
from ..schemas import conform_analyses, conform_leads

RECENT_ROWS = 20
RECENT_SHOWN = 50
RECENT_LEADS = 50
POPULAR_REPOS = 10


def valid_repo_urls(requests: DataFrame) -> DataFrame:
    """Requests whose ``url`` names a repository, with the cleaned address, its parts and its cache key."""
    cleaned = requests.withColumn("repo_url", clean_url(F.col("url"))).where(is_repo_url(F.col("repo_url")))
    url = F.col("repo_url")
    return cleaned.withColumns(
        {"owner": repo_owner(url), "repo_name": repo_name(url), "cache_key": cache_key(url)}
    )


def new_repos_only(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Valid requests for which no result is stored."""
    return requests.join(results.select("cache_key").distinct(), "cache_key", "left_anti")


def known_repos(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Valid requests answered from stored results: ``cached`` is true and the duration 0."""
    hits = requests.join(results.select("cache_key").distinct(), "cache_key", "left_semi")
    return hits.withColumns({"cached": F.lit(True), "duration_seconds": F.lit(0.0)})


def has_contact() -> Column:
    """A lead must hold a non-empty e-mail address or profile."""
    return (F.coalesce("email", F.lit("")) != "") | (F.coalesce("linkedin", F.lit("")) != "")


def valid_leads(leads: DataFrame) -> DataFrame:
    return leads.where(has_contact())


def usage_totals(analyses: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: analyses, distinct repositories, leads."""
    ran = analyses.agg(
        F.count("*").alias("total_analyses"), F.count_distinct("repo_url").alias("unique_repos")
    )
    made = leads.agg(F.count("*").alias("total_leads"))
    return ran.withColumn("_one", F.lit(1)).join(made.withColumn("_one", F.lit(1)), "_one").drop("_one")


def repo_popularity(analyses: DataFrame) -> DataFrame:
    """Per address: number of analyses, the latest, and the name it gave."""
    latest = F.max(F.struct("timestamp", "repo_name"))
    return (
        analyses.groupBy("repo_url")
        .agg(latest.alias("latest"), F.count("*").alias("analysis_count"))
        .select(
            "repo_url",
            F.col("latest.repo_name").alias("repo_name"),
            "analysis_count",
            F.col("latest.timestamp").alias("last_analyzed"),
        )
    )


def popular_repos(analyses: DataFrame, limit: int = POPULAR_REPOS) -> DataFrame:
    return repo_popularity(analyses).orderBy(F.desc("analysis_count"), F.asc("repo_url")).limit(limit)


def recent_analyses(analyses: DataFrame, limit: int = RECENT_ROWS) -> DataFrame:
    return conform_analyses(analyses).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def recent_leads(leads: DataFrame, limit: int = RECENT_LEADS) -> DataFrame:
    return conform_leads(leads).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def run_summary(
    file_counts: DataFrame,
    ranked: DataFrame,
    sizes: DataFrame,
    churn: DataFrame,
    spots: DataFrame,
    symbol_totals: DataFrame,
    repos: DataFrame | None = None,
) -> DataFrame:
    """The analyses row of each repository: sizes of its result tables and their first entries.

    With ``repos`` each of its repositories has a row and no other; without it one counts once it has files or history.
    Counts of what it lacks are 0.
    """
    first_spot = F.max(F.struct("hotspot_score", -F.col("rank_position"), "file"))
    parts = [
        file_counts.select("repo_id", "file_count"),
        ranked.groupBy("repo_id").agg(
            F.count("*").alias("ranked_files_count"),
            F.min_by("file", "rank_position").alias("top_ranked_file"),
        ),
        sizes.select("repo_id", "graph_nodes", "graph_edges"),
        churn.groupBy("repo_id").agg(
            F.count("*").alias("churn_files_count"),
            F.min_by("filename", "position").alias("top_churned_file"),
            F.max("total_contributor").alias("churn_total_contributors"),
        ),
        spots.groupBy("repo_id").agg(
            F.count("*").alias("hotspot_count"), first_spot["file"].alias("top_hotspot_file")
        ),
        symbol_totals.select("repo_id", F.col("total_symbols").alias("ast_symbol_count")),
    ]
    joined, how = (parts.pop(0), "full") if repos is None else (repos.select("repo_id"), "left")
    for part in parts:
        joined = joined.join(part, "repo_id", how)
    counts = [
        "file_count",
        "ranked_files_count",
        "churn_files_count",
        "hotspot_count",
        "graph_nodes",
        "graph_edges",
        "ast_symbol_count",
        "churn_total_contributors",
    ]
    firsts = ["top_ranked_file", "top_churned_file", "top_hotspot_file"]
    return joined.select("repo_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in counts], *firsts)


def cached_summary(summary: DataFrame) -> DataFrame:
    """The analyses row of a run answered from stored results: graph and symbol counts and duration are 0."""
    zero = ["graph_nodes", "graph_edges", "ast_symbol_count", "churn_total_contributors"]
    return summary.withColumns(
        {**{c: F.lit(0) for c in zero}, "duration_seconds": F.lit(0.0)}
    )


def analysis_records(
    summary: DataFrame,
    repos: DataFrame,
    at: dt.datetime,
    duration_seconds: float = 0.0,
    ip_address: str | None = None,
    user_agent: str | None = None,
) -> DataFrame:
    """Log rows of a run: ``summary`` with the addresses in ``repos(repo_id, repo_url, repo_name)``."""
    rows = summary.join(repos.select("repo_id", "repo_url", "repo_name"), "repo_id").withColumns(
        {
            "timestamp": F.lit(at).cast("timestamp_ntz"),
            "ip_address": F.lit(ip_address),
            "user_agent": F.lit(user_agent),
        }
    )
    if "duration_seconds" not in rows.columns:
        rows = rows.withColumn("duration_seconds", F.round(F.lit(float(duration_seconds)), 2))
    return conform_analyses(rows.withColumn("id", F.xxhash64("repo_url", "timestamp")))
