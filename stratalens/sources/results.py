"""Result documents, their store, and the CSV report.

A repository's result has lists of any length (ranked files, edges, symbols), so its document is not one value:
it is one ``summary`` row with the bounded parts, and one row per list entry, each a JSON text with its place.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.hotspots import hotspot_order
from ..functions.positions import all_positions
from ..functions.urls import cache_key
from ..schemas import RESULTS, RUNS
from ..session import cut_lineage

SUMMARY = "summary"

_STORED = ["cache_key", "section", "position", "doc"]
_STORE = StructType(RESULTS.fields).add("run", StringType())


def _entries(df: DataFrame, section: str, position: Column, fields: list[str]) -> DataFrame:
    return df.select(
        "repo_id",
        F.lit(section).alias("section"),
        position.cast("bigint").alias("position"),
        F.to_json(F.struct(*fields)).alias("doc"),
    )


def summary_documents(repos: DataFrame, summary: DataFrame, churn_totals: DataFrame, churn: DataFrame) -> DataFrame:
    """One document per repository: its name and address, sizes, and the churn table, as many rows as were asked for."""
    order = ["position", "filename", *[c for c in churn.columns if c not in ("repo_id", "position", "filename")]]
    rows = churn.select("repo_id", F.struct(*order).alias("_row"))
    top = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    listed = F.coalesce("_rows", F.from_json(F.lit("[]"), top.schema["_rows"].dataType)).alias("top_files")
    history = (
        churn_totals.join(top, "repo_id", "left")
        .select("repo_id", F.struct("period", "total_files_with_commits", listed).alias("churn"))
    )
    sizes = [c for c in summary.columns if c not in ("repo_id", "file_count")]
    doc = F.to_json(F.struct("repo_name", "repo_url", "file_count", F.struct(*sizes).alias("sizes"), "churn"))
    return (
        repos.join(summary, "repo_id")
        .join(history, "repo_id", "left")
        .select("repo_id", F.lit(SUMMARY).alias("section"), F.lit(0).cast("bigint").alias("position"), doc.alias("doc"))
    )


def result_documents(results: dict[str, DataFrame]) -> DataFrame:
    """``repo_id, section, position, doc`` of an analysis (see ``plans.pipelines.analyze``)."""
    spots = all_positions(results["hotspots"], ["repo_id"], [*hotspot_order(), F.asc("file")], "position")
    unplaced = F.lit(None)
    parts = [
        results["summary_documents"],
        _entries(
            results["ranked_files"], "ranked_files", F.col("rank_position"),
            ["rank_position", "file", "pagerank_score", "centrality"],
        ),
        _entries(results["nodes"], "nodes", unplaced, ["id", "pagerank", "centrality"]),
        _entries(results["edges"], "edges", unplaced, ["source", "target", "weight", "ident"]),
        _entries(results["tree"], "tree", unplaced, ["path", "parent", "depth", "name", "node_type", "symbol_count"]),
        _entries(results["symbols"], "symbols", unplaced, ["path", "line", "name"]),
        _entries(
            spots, "hotspots", F.col("position"),
            ["file", "pagerank_score", "centrality", "commits", "total_churn", "hotspot_score"],
        ),
    ]
    documents = parts[0]
    for part in parts[1:]:
        documents = documents.unionByName(part)
    return documents


def write_json(documents: DataFrame, folder: str) -> None:
    """Documents as JSON lines in one folder per section."""
    documents.withColumn("doc", F.to_json(F.struct("repo_id", "position", "doc"))).select(
        "section", F.col("doc").alias("value")
    ).write.mode("overwrite").partitionBy("section").text(folder)


def _write_run(documents: DataFrame, folder: str, run: str) -> None:
    """Documents of a run, in order of key, so that a lookup reads few row groups; long lists spread by their text."""
    ordered = documents.withColumn("run", F.lit(run)).repartitionByRange("section", "cache_key", F.xxhash64("doc"))
    ordered.sortWithinPartitions("section", "cache_key").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run", "section").parquet(f"{folder}/documents")


def _publish_run(runs: DataFrame, folder: str) -> None:
    """From here on readers see the run, and no longer those it takes the place of."""
    runs.select(*RUNS.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run"
    ).parquet(f"{folder}/runs")


def store_results(
    documents: DataFrame, repos: DataFrame, folder: str, at: dt.datetime, run: str | None = None
) -> None:
    """Add documents to the result store under the cache key of their repository's address.

    They are seen as a whole once all are written, or not at all. A ``run`` that is stored again under its name replaces
    what its first try left.
    """
    run = run or uuid.uuid4().hex
    computed = F.lit(at).cast("timestamp_ntz")
    keys = repos.select("repo_id", cache_key(F.col("repo_url")).alias("cache_key"))
    _write_run(documents.join(keys, "repo_id").select(computed.alias("computed_at"), *_STORED), folder, run)
    one = documents.sparkSession.range(1)
    _publish_run(
        one.select(F.lit(run).alias("run"), computed.alias("computed_at"), F.lit(None).cast("string").alias("replaced")),
        folder,
    )


def _live_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Published runs that no other run has taken the place of."""
    runs = spark.read.schema(RUNS).parquet(f"{folder}/runs")
    gone = runs.where(F.col("replaced").isNotNull()).select(F.col("replaced").alias("run"))
    return runs.select("run").distinct().join(gone, "run", "left_anti")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all published runs."""
    stored = spark.read.schema(_STORE).parquet(f"{folder}/documents")
    return stored.join(_live_runs(spark, folder), "run", "left_semi").select(*RESULTS.names)


def compact_results(spark: SparkSession, folder: str, run: str | None = None) -> None:
    """Rewrite the latest documents of each key as one run that takes the place of all others.

    The files of the older runs stay for readers that have begun; no reader that begins later opens them. Only one
    compaction may run at a time; runs stored meanwhile stay.
    """
    run = run or uuid.uuid4().hex
    older = cut_lineage(_live_runs(spark, folder).where(F.col("run") != run))
    stored = spark.read.schema(_STORE).parquet(f"{folder}/documents").join(older, "run", "left_semi")
    _write_run(latest_results(stored.select(*RESULTS.names)), folder, run)
    _publish_run(
        older.select(
            F.lit(run).alias("run"), F.lit(None).cast("timestamp_ntz").alias("computed_at"), F.col("run").alias("replaced")
        ),
        folder,
    )


def latest_results(results: DataFrame) -> DataFrame:
    """Of each key the rows of its latest run whose summary can be read; a broken summary is a miss."""
    address = F.from_json("doc", "repo_url string")["repo_url"]
    readable = results.where((F.col("section") == SUMMARY) & address.isNotNull())
    newest = readable.groupBy("cache_key").agg(F.max("computed_at").alias("computed_at"))
    return results.join(newest, ["cache_key", "computed_at"], "left_semi")


# Columns of the report, by section, as (source column, heading).
REPORT_COLUMNS = {
    "ranked_files": [
        ("rank_position", "Rank"),
        ("file", "File"),
        ("pagerank_score", "PageRank Score"),
        ("centrality", "Centrality"),
    ],
    "churn": [
        ("position", "#"),
        ("filename", "File"),
        ("commits", "Commits"),
        ("total_churn", "Total Churn"),
        ("lines_added", "Lines Added"),
        ("removed_lines", "Lines Removed"),
        ("total_contributor", "Contributors"),
    ],
    "hotspots": [
        ("file", "File"),
        ("hotspot_score", "Hotspot Score"),
        ("pagerank_score", "PageRank"),
        ("commits", "Commits"),
        ("total_churn", "Total Churn"),
        ("centrality", "Centrality"),
    ],
}

_REPORT_ORDER = {
    "ranked_files": lambda: [F.asc("rank_position")],
    "churn": lambda: [F.asc("position")],
    "hotspots": hotspot_order,
}


def report_section(rows: DataFrame, section: str) -> DataFrame:
    """A section of the report with its headings, in report order per repository."""
    chosen = [F.col(name).alias(heading) for name, heading in REPORT_COLUMNS[section]]
    return rows.orderBy("repo_id", *_REPORT_ORDER[section]()).select("repo_id", *chosen)


def write_report(results: dict[str, DataFrame], folder: str) -> None:
    """The report as CSV, one folder per section."""
    for section in REPORT_COLUMNS:
        report_section(results[section], section).write.mode("overwrite").option("header", True).csv(
            f"{folder}/{section}"
        )
