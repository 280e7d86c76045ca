"""Named queries over the test tables, one per operator.

Each takes a session and the folder of the tables. ``oracles`` holds the SQL each one is checked against.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import churn as ch
from ..operators import graph, hotspots as hs, rank, scopes, tags as tg, text, tree, usage
from ..schemas import LEADS
from ..session import shared_folder
from ..sources import history, results, usage_log
from ..sources.files import file_counts, missing_files
from ..sources.rules import RULES, Rule
from ..streaming import usage_feed
from . import pipelines
from .samples import SAMPLES

Query = Callable[[SparkSession, str], DataFrame]

# The language of the prose documents is their extension; rules for prose stand in for those of code.
PROSE = {ext: "prose" for ext in ("de", "en", "es", "fr", "it", "nl", "pt")}
PROSE_RULES = [Rule("prose", "def", "word", r"^([A-Z][a-z]+)"), Rule("prose", "ref", "word", r"([a-z]+)")]
PROSE_DEFS = PROSE_RULES[:1]
PROSE_KEYWORDS = {"prose": ["the", "of", "and"]}
# Rules whose definitions are also referred to.
PROSE_LINKED = [Rule("prose", "def", "word", r"^[A-Z]([a-z]+)"), PROSE_RULES[1]]

FIXED_ROUNDS = 20
SHOWN_NODES = 20
LOOKED_UP = "dir3/f3.py"
SEARCHED = "K7"
ANALYSES_AGE = "2024-01-03"
# Languages whose samples refer to each other's definitions.
RANKED_LANGS = ["php", "python"]
STORED_AT = dt.datetime(2024, 1, 1)


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return b.bind(spark, folder, b.TAGS)


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return b.bind(spark, folder, b.COMMIT_FILES)


def _window(spark: SparkSession, folder: str) -> DataFrame:
    return ch.history_window(_commits(spark, folder), b.AS_OF, b.MONTHS)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return b.bind(spark, folder, b.SOURCE_FILES)


def _prose(spark: SparkSession, folder: str, rules: list[Rule], **options) -> DataFrame:
    return tg.tag_files(
        _files(spark, folder), rules=rules, extensions=PROSE, skipped={}, keywords=PROSE_KEYWORDS, **options
    )


def _analyses(spark: SparkSession, folder: str) -> DataFrame:
    return b.bind(spark, folder, b.ANALYSES)


def _leads(spark: SparkSession, folder: str) -> DataFrame:
    return b.bind(spark, folder, b.LEADS)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return usage.valid_repo_urls(b.bind(spark, folder, b.URLS))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Results in a store that holds one for each address whose repository number is even."""
    number = F.regexp_extract("repo_url", "/org([0-9]+)/", 1).try_cast("int")
    asked = _asked(spark, folder)
    store = shared_folder(spark)
    results.store_results(_answers(asked).where(number % 2 == 0), asked, store, STORED_AT)
    return results.latest_results(results.read_results(spark, store))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses that are asked for, in the case they are asked in, and how often."""
    return _requests(spark, folder).groupBy("repo_url").agg(F.count("*").alias("asked")).withColumn("repo_id", F.col("repo_url"))


def _answers(asked: DataFrame) -> DataFrame:
    """A summary document for each address."""
    doc = F.to_json(F.struct("repo_url", "asked"))
    place = F.lit(0).cast("bigint").alias("position")
    return asked.select("repo_id", "repo_url", F.lit(results.SUMMARY).alias("section"), place, doc.alias("doc"))


def _repos(tags: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://github.com/org/"), F.col("repo_id"))
    return tags.select("repo_id").distinct().select("repo_id", url.alias("repo_url"), F.col("repo_id").alias("repo_name"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.tag_pairs(_tags(spark, folder))


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return graph.keep_pairs(_tags(spark, folder))


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    return rank.rank_files(_kept(spark, folder))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return rank.ranked_files(_ranks(spark, folder))


def _churn(spark: SparkSession, folder: str) -> DataFrame:
    return ch.churn_files(_window(spark, folder))


def _digits(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def churn_top_files(spark, folder):
    return _churn(spark, folder)


def churn_all_files(spark, folder):
    return ch.churn_files(_window(spark, folder), k=None)


def churn_totals(spark, folder):
    return ch.churn_totals(_window(spark, folder), b.AS_OF, b.MONTHS)


def minor_contributors(spark, folder):
    return ch.minor_contributors(_window(spark, folder))


def contributor_experience(spark, folder):
    return ch.contributor_experience(_window(spark, folder))


def churn_process_metrics(spark, folder):
    means = ["Avg_churn", "avg_lines_added_per_commit", "avg_lines_removed_per_commit"]
    table = ch.process_metrics(_window(spark, folder))
    return table.withColumns({c: F.round(c, 6) for c in means})


def churn_process_gross(spark, folder):
    table = ch.process_metrics(_window(spark, folder), churn="gross")
    return table.select("repo_id", "position", "filename", "commits", "Total_churn", "Max_churn", *_digits("Avg_churn"))


def churn_find_file(spark, folder):
    return ch.find_file(_churn(spark, folder), "f1")


def churn_chart(spark, folder):
    return ch.churn_chart(_churn(spark, folder)).withColumn("bar", F.round("bar", 6))


def definers(spark, folder):
    return graph.definers(_pairs(spark, folder))


def ref_counts(spark, folder):
    return graph.ref_counts(_pairs(spark, folder))


def ref_counts_without_refs(spark, folder):
    return graph.ref_counts(graph.tag_pairs(_tags(spark, folder).where(F.col("kind") == "def")))


def linked_names(spark, folder):
    return graph.linked_names(_pairs(spark, folder))


def dependency_edges(spark, folder):
    return graph.edge_listing(_pairs(spark, folder))


def graph_sizes(spark, folder):
    return graph.graph_sizes(_pairs(spark, folder))


def degree_centrality(spark, folder):
    return graph.degree_centrality(_pairs(spark, folder)).withColumn("centrality", F.round("centrality", 6))


def most_central(spark, folder):
    found = graph.most_central(graph.degree_centrality(_pairs(spark, folder)))
    return found.withColumn("centrality", F.round("centrality", 6))


def top_n_nodes(spark, folder):
    nodes = graph.top_nodes(_ranks(spark, folder), SHOWN_NODES)
    return nodes.withColumn("relative_rank", F.round("relative_rank", 4))


def top_n_subgraph(spark, folder):
    pairs = _kept(spark, folder)
    nodes = graph.top_nodes(rank.rank_files(pairs), SHOWN_NODES)
    return graph.subgraph_edges(pairs, nodes).withColumn("weight", F.round("weight", 4))


def collapsed_edges(spark, folder):
    pairs = _kept(spark, folder)
    nodes = graph.top_nodes(rank.rank_files(pairs), SHOWN_NODES)
    edges = graph.collapse_edges(graph.subgraph_edges(pairs, nodes))
    return edges.select("repo_id", "source", "target", *_digits("weight", digits=4), F.array_join("idents", ",").alias("idents"))


def collapsed_graph(spark, folder):
    edges = graph.dependency_edges(_pairs(spark, folder)).where(F.col("source") != F.col("target"))
    shown = graph.collapse_edges(edges)
    return shown.select("repo_id", "source", "target", *_digits("weight", digits=4), F.array_join("idents", ",").alias("idents"))


def pagerank_files(spark, folder):
    return _ranked(spark, folder)


def pagerank_empty_names(spark, folder):
    """A name that is empty is a name like any other."""
    name = F.when(F.col("name").rlike("[05]0$"), F.lit("")).otherwise(F.col("name"))
    return rank.ranked_files(rank.rank_files(graph.keep_pairs(_tags(spark, folder).withColumn("name", name))))


def pagerank_fixed_rounds(spark, folder):
    ranks = rank.rank_files(_kept(spark, folder), tolerance=0.0, max_rounds=FIXED_ROUNDS)
    return ranks.select("repo_id", "file", *_digits("rank", digits=9))


def pagerank_nodes(spark, folder):
    return rank.node_listing(_ranks(spark, folder))


def pagerank_top(spark, folder):
    return rank.top_ranked_files(_ranks(spark, folder), 3)


def pagerank_bars(spark, folder):
    return rank.rank_bars(_ranked(spark, folder)).withColumn("percent", F.round("percent", 3))


def ranked_definitions(spark, folder):
    pairs = _kept(spark, folder)
    return rank.ranked_definitions(pairs, rank.rank_files(pairs)).withColumn("rank", F.round("rank", 9))


def ordered_definitions(spark, folder):
    pairs = _kept(spark, folder)
    ordered = rank.ordered_definitions(rank.ranked_definitions(pairs, rank.rank_files(pairs)))
    return ordered.withColumn("rank", F.round("rank", 9))


def ranked_tags(spark, folder):
    tags = _tags(spark, folder)
    pairs = graph.keep_pairs(tags)
    listed = rank.in_tag_order(rank.ranked_tags(tags, pairs, rank.rank_files(pairs)))
    return listed.withColumn("rank", F.round("rank", 9))


def file_rank_lookup(spark, folder):
    found = rank.file_rank_lookup(_ranked(spark, folder), LOOKED_UP)
    return found.withColumn("top_files", F.array_join("top_files", ","))


def hotspots(spark, folder):
    return hs.hotspots(_ranked(spark, folder), _churn(spark, folder)).orderBy("repo_id", *hs.hotspot_order())


def hotspots_exact(spark, folder):
    return hs.hotspots(_ranked(spark, folder), _churn(spark, folder), match=hs.EXACT)


def hotspots_all_churn(spark, folder):
    churn = ch.churn_files(_window(spark, folder), k=None)
    return hs.hotspots(_ranked(spark, folder), churn, k=None)


def prioritization_matrix(spark, folder):
    points = hs.prioritization_matrix(_ranked(spark, folder), _churn(spark, folder))
    return points.withColumns({c: F.round(c, 6) for c in ("x", "y", "size")})


def file_languages(spark, folder):
    files = _files(spark, folder).where(F.length("content") > 0)
    known = files.select("repo_id", "path", tg.language_of(F.col("path"), PROSE).alias("lang"))
    return known.where(F.col("lang").isNotNull())


def extract_tags(spark, folder):
    return _prose(spark, folder, PROSE_RULES)


def backfill_refs(spark, folder):
    return _prose(spark, folder, PROSE_DEFS).where(F.col("line") == tg.BACKFILLED_LINE)


def file_symbols(spark, folder):
    return tg.file_symbols(_prose(spark, folder, PROSE_RULES))


def definition_tags(spark, folder):
    return tg.definition_tags(_tags(spark, folder))


def repo_map_lines(spark, folder):
    pairs = graph.keep_pairs(_prose(spark, folder, PROSE_LINKED))
    definitions = tg.tag_definitions(
        _files(spark, folder), PROSE_LINKED, extensions=PROSE, skipped={}, keywords=PROSE_KEYWORDS, with_text=True
    )
    return text.repo_map_lines(definitions, pairs)


def repo_map_text(spark, folder):
    return pipelines.repo_map_blocks(
        _files(spark, folder), rules=PROSE_LINKED, extensions=PROSE, skipped={}, keywords=PROSE_KEYWORDS
    )


def ranked_tags_of_text(spark, folder):
    """Ranked definitions of code files, from their text."""
    source = b.code_files(spark, folder, RANKED_LANGS)
    return pipelines.ranked_tag_list(source).withColumn("rank", F.round("rank", 9))


def prose_graph(spark, folder):
    return graph.graph_sizes(graph.keep_pairs(_prose(spark, folder, PROSE_LINKED)))


def _tags_of(lang: str) -> Query:
    def query(spark, folder):
        return tg.tag_files(b.code_files(spark, folder, [lang]), [rule for rule in RULES if rule.lang == lang])

    query.__name__ = f"tags_{lang}"
    return query


def tag_scopes(spark, folder):
    definitions = tg.tag_definitions(b.code_files(spark, folder, list(SAMPLES)), with_text=True, with_scopes=True)
    return scopes.tag_scopes(definitions).withColumn("heads", F.array_join(F.transform("heads", lambda h: h.cast("string")), ","))


def repo_map_scopes(spark, folder):
    return pipelines.repo_map_blocks(b.code_files(spark, folder, list(SAMPLES)))


def parse_numstat(spark, folder):
    """The commit_files binding written as log text and read back."""
    counts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("added", "removed")]
    seconds = F.unix_seconds(F.col("commit_ts").cast("timestamp")).cast("string")
    header = F.concat_ws(":", F.lit("COMMIT"), "commit_hash", "author_email", seconds)
    record = F.concat(header, F.lit("\n"), F.concat_ws("\t", *counts, "path"), F.lit("\n"))
    return history.parse_history(_commits(spark, folder).select("repo_id", record.alias("record")))


def history_roundtrip(spark, folder):
    """The commit_files binding written as logs, commits of many files among them, and read back line by line."""
    counts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("added", "removed")]
    seconds = F.unix_seconds(F.col("commit_ts").cast("timestamp")).cast("string")
    header = F.concat_ws(":", F.lit("COMMIT"), "commit_hash", "author_email", seconds)
    commit = ["repo_id", "commit_hash"]
    commits = _commits(spark, folder).withColumns({"header": header, "line": F.concat_ws("\t", *counts, "path")})
    headers = commits.select(*commit, F.lit(0).alias("part"), F.col("header").alias("value")).distinct()
    lines = commits.select(*commit, F.lit(1).alias("part"), F.col("line").alias("value")).unionByName(headers)
    logs = shared_folder(spark)
    ordered = lines.repartition(*commit).sortWithinPartitions(*commit, "part")
    ordered.select("repo_id", "value").write.partitionBy("repo_id").text(logs)
    return history.parse_history(history.read_history(spark, logs))


def symbol_tree(spark, folder):
    return tree.in_tree_order(tree.symbol_tree(tg.file_symbols(_tags(spark, folder))))


def symbol_tree_of_text(spark, folder):
    return tree.shown_nodes(tree.symbol_tree(tg.file_symbols(_prose(spark, folder, PROSE_RULES))))


def tree_files(spark, folder):
    return tree.tree_files(tree.symbol_tree(tg.file_symbols(_tags(spark, folder))))


def symbol_totals(spark, folder):
    return tree.symbol_totals(tree.symbol_tree(tg.file_symbols(_tags(spark, folder))))


def symbol_search(spark, folder):
    symbols = tg.file_symbols(_tags(spark, folder))
    return tree.symbol_search(tree.symbol_tree(symbols), symbols, SEARCHED)


def total_files(spark, folder):
    return file_counts(_files(spark, folder))


def missing_file_names(spark, folder):
    files = _files(spark, folder)
    wanted = files.select("repo_id").distinct().withColumn(
        "text", F.explode(F.array(F.lit("en/d1/1"), F.lit("fr/d"), F.lit(".txt")))
    )
    return missing_files(files, wanted)


def usage_totals(spark, folder):
    return usage.usage_totals(_analyses(spark, folder), usage.valid_leads(_leads(spark, folder)))


def popular_repos(spark, folder):
    return usage.popular_repos(_analyses(spark, folder))


def repo_popularity(spark, folder):
    return usage.repo_popularity(_analyses(spark, folder))


def recent_analyses(spark, folder):
    return usage.recent_analyses(_analyses(spark, folder))


def recent_leads(spark, folder):
    return usage.recent_leads(usage.valid_leads(_leads(spark, folder)))


def valid_leads(spark, folder):
    return usage.valid_leads(_leads(spark, folder))


def merged_analyses(spark, folder):
    """Records from before and after a column was added, as one table."""
    log = _analyses(spark, folder)
    recent = F.col("timestamp") >= F.lit(ANALYSES_AGE).cast("timestamp_ntz")
    older = log.where(~recent).drop("churn_files_count")
    newer = log.where(recent).withColumn("graph_nodes", F.col("file_count") + 1)
    return usage_log.merge_analyses(older, newer)


def _recent(log: DataFrame) -> Column:
    return F.col("timestamp") >= F.lit(ANALYSES_AGE).cast("timestamp_ntz")


def analyses_log(spark, folder):
    """Older analyses in files of another schema, newer ones appended to them, the append tried twice."""
    log, stored = _analyses(spark, folder), shared_folder(spark)
    older = log.where(~_recent(log)).withColumn("file_count", F.col("file_count").cast("smallint"))
    older.drop("churn_files_count").write.parquet(stored)
    for _ in range(2):
        newer = log.where(_recent(log)).withColumn("graph_nodes", F.col("file_count") + 1)
        usage_log.append_analyses(newer, stored, "newer")
    return usage_log.read_analyses(spark, stored)


def leads_log(spark, folder):
    """Leads appended in two batches, each tried twice, those without a contact among them."""
    log, stored = _leads(spark, folder), shared_folder(spark)
    for part, rows in {"newer": _recent(log), "older": ~_recent(log)}.items():
        for _ in range(2):
            usage_log.append_leads(log.where(rows), stored, part)
    return usage_log.read_leads(spark, stored)


def exported_leads(spark, folder):
    """The CSV export of the leads, read back."""
    exported = shared_folder(spark)
    usage_log.export_leads(usage.valid_leads(_leads(spark, folder)), exported)
    times = {"header": True, "timestampNTZFormat": usage_log.TIME_FORMAT}
    return spark.read.schema(LEADS).options(**times).csv(exported)


def popularity_stream(spark, folder):
    """The popularity table kept by a stream over a log that is appended to between its runs."""
    log, feed, table, state = _analyses(spark, folder), *(shared_folder(spark) for _ in range(3))
    for rows in (~_recent(log), _recent(log)):
        usage_log.append_analyses(log.where(rows), feed)
        usage_feed.keep_popularity(usage_feed.stream_analyses(spark, feed), table, state, 2).awaitTermination()
    return usage_feed.read_popularity(spark, table)


def admin_metrics(spark, folder):
    """The tables of the operator's view, one below the other."""
    found = pipelines.admin_metrics(_analyses(spark, folder), usage.valid_leads(_leads(spark, folder)))
    totals = found["totals"].select(F.explode(F.create_map(*(
        x for name in found["totals"].columns for x in (F.lit(name), F.col(name))
    ))).alias("name", "number"))
    parts = [totals.select(F.lit("totals").alias("section"), "name", "number")]
    for section, number in {"recent": "id", "popular": "analysis_count", "leads": "id"}.items():
        parts.append(found[section].select(F.lit(section), F.col("repo_url"), F.col(number)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


def exported_analyses(spark, folder):
    return usage_log.newest_first(usage_log.merge_analyses(_analyses(spark, folder)))


def valid_repo_urls(spark, folder):
    return _requests(spark, folder)


def cache_keys(spark, folder):
    return _requests(spark, folder).select("repo_url", "cache_key").distinct()


def new_repos_only(spark, folder):
    return usage.new_repos_only(_requests(spark, folder), _stored(spark, folder)).select("repo_url", "cache_key")


def known_repos(spark, folder):
    known = usage.known_repos(_requests(spark, folder), _stored(spark, folder))
    return known.select("repo_url", "cache_key", "cached", "duration_seconds")


def stored_results(spark, folder):
    """Of a store with three runs the latest readable documents: the second run's summaries of addresses that were asked
    for once are broken, and the third, stored twice under one name, holds addresses asked for often. Then it is compacted."""
    asked = _asked(spark, folder)
    answers, store = _answers(asked), shared_folder(spark)
    results.store_results(answers, asked, store, STORED_AT)
    once = answers.where(F.get_json_object("doc", "$.asked") == "1")
    broken = once.withColumn("doc", F.substring("doc", 1, 20))
    results.store_results(broken, asked, store, STORED_AT + dt.timedelta(days=1))
    often = answers.where(F.get_json_object("doc", "$.asked") != "1")
    for _ in range(2):
        results.store_results(often, asked, store, STORED_AT + dt.timedelta(days=2), "third")
    results.compact_results(spark, store)
    return results.latest_results(results.read_results(spark, store))


def _analysis(spark, folder) -> dict[str, DataFrame]:
    tags = _tags(spark, folder)
    return pipelines.analyze(tags, _commits(spark, folder), _repos(tags), b.AS_OF, b.MONTHS)


def run_summary_all_repos(spark, folder):
    """Also of a repository that has neither tags nor history."""
    tags = _tags(spark, folder)
    repos = _repos(tags)
    bare = repos.limit(1).select(F.lit("none").alias("repo_id"), "repo_url", F.lit("none").alias("repo_name"))
    results = pipelines.analyze(tags, _commits(spark, folder), repos.unionByName(bare), b.AS_OF, b.MONTHS)
    return results["summary"].join(results["churn_totals"], "repo_id")


def run_summary(spark, folder):
    return _analysis(spark, folder)["summary"]


def cached_summary(spark, folder):
    return usage.cached_summary(_analysis(spark, folder)["summary"])


def report_ranked(spark, folder):
    return results.report_section(_ranked(spark, folder), "ranked_files")


def report_churn(spark, folder):
    return results.report_section(_churn(spark, folder), "churn")


def report_hotspots(spark, folder):
    found = hs.hotspots(_ranked(spark, folder), _churn(spark, folder))
    return results.report_section(found, "hotspots")


def result_json(spark, folder):
    return results.result_documents(_analysis(spark, folder))


def result_entries(spark, folder):
    """The list entries of the result documents as typed columns."""
    fields = (
        "rank_position int, file string, pagerank_score double, centrality double, id string, pagerank double, source string,"
        " target string, weight double, ident string, path string, parent string, depth int, name string, node_type string,"
        " symbol_count bigint, line int, commits bigint, total_churn bigint, hotspot_score double"
    )
    entries = result_json(spark, folder).where(F.col("section") != results.SUMMARY)
    return entries.select("repo_id", "section", "position", F.from_json("doc", fields).alias("entry")).select(
        "repo_id", "section", "position", "entry.*"
    )


def result_summaries(spark, folder):
    """The summaries of the result documents as typed columns, a row for each file of their churn tables."""
    files = "position int, filename string, commits bigint, total_contributor bigint, total_churn bigint, lines_added bigint"
    fields = (
        "repo_name string, repo_url string, file_count int, sizes struct<graph_nodes: int, graph_edges: int, hotspot_count: int,"
        " top_hotspot_file: string>, churn struct<period: string, total_files_with_commits: bigint, top_files: array<struct<"
        + files.replace(" ", ": ").replace(",: ", ", ") + ">>>"
    )
    summaries = _analysis(spark, folder)["summary_documents"].select("repo_id", F.from_json("doc", fields).alias("doc"))
    return summaries.select("repo_id", "doc.*", F.explode("doc.churn.top_files").alias("top")).select(
        "repo_id", "repo_name", "repo_url", "file_count", "sizes.*", "churn.period", "churn.total_files_with_commits", "top.*"
    )


def result_sections(spark, folder):
    """Entries per section of the result documents, and what their texts hold when read back."""
    fields = "rank_position int, total_churn bigint, symbol_count bigint, line int, file_count int"
    doc = F.from_json("doc", fields)
    sums = [c.split()[0] for c in fields.split(", ")]
    return (
        result_json(spark, folder)
        .select("repo_id", "section", doc.alias("entry"))
        .groupBy("repo_id", "section")
        .agg(F.count("*").alias("entries"), *[F.sum(f"entry.{c}").alias(c) for c in sums])
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in [
        churn_top_files, churn_all_files, churn_totals, minor_contributors, contributor_experience,
        churn_process_metrics, churn_process_gross, churn_find_file, churn_chart,
        definers, ref_counts, ref_counts_without_refs, linked_names, dependency_edges, graph_sizes,
        degree_centrality, most_central, top_n_nodes, top_n_subgraph, collapsed_edges, collapsed_graph,
        pagerank_files, pagerank_empty_names, pagerank_fixed_rounds, pagerank_nodes, pagerank_top, pagerank_bars,
        ranked_definitions, ordered_definitions, ranked_tags, file_rank_lookup,
        hotspots, hotspots_exact, hotspots_all_churn, prioritization_matrix,
        file_languages, extract_tags, backfill_refs, file_symbols, definition_tags,
        repo_map_lines, repo_map_text, ranked_tags_of_text, prose_graph, parse_numstat, history_roundtrip,
        *map(_tags_of, SAMPLES), tag_scopes, repo_map_scopes,
        symbol_tree, symbol_tree_of_text, tree_files, symbol_totals, symbol_search, total_files, missing_file_names,
        usage_totals, popular_repos, repo_popularity, recent_analyses, recent_leads, valid_leads, merged_analyses,
        exported_analyses, valid_repo_urls, cache_keys, new_repos_only, known_repos,
        analyses_log, leads_log, exported_leads, popularity_stream, admin_metrics, stored_results,
        run_summary, run_summary_all_repos, cached_summary, report_ranked, report_churn, report_hotspots,
        result_json, result_sections, result_entries, result_summaries,
    ]
}
