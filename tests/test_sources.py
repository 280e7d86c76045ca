"""Files, logs, usage records and result stores, written and read back."""

import datetime as dt
import json

import pandas as pd
import pytest

from stratalens import bindings as b
from stratalens.functions import paths
from stratalens.operators import tree, usage
from stratalens.plans import pipelines
from stratalens.schemas import ANALYSES, LEADS
from stratalens.functions.numbers import in_window
from stratalens.sources import files, history, results, usage_log
from stratalens.streaming import usage_feed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
AT = dt.datetime(2024, 5, 1, 12)


@pytest.fixture
def corpus(tmp_path):
    def put(path, data):
        target = tmp_path / "corpus" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    put("one/src/a.py", b"def a(): b()\n")
    put("one/my dir/b+c.py", b"def b(): pass\n")
    put("one/src/__init__.py", b"def start(): pass\n")
    put("one/.git/hook.py", b"def hook(): pass\n")
    put("one/bad.py", b"def \xff(): pass\n")
    put("one/notes.txt", b"hello\n")
    put("two/a.go", b"package main\nfunc main() {}\n")
    put("two/empty.go", b"")
    return str(tmp_path / "corpus")


def test_read_source_files(spark, corpus, rows):
    table = files.read_source_files(spark, corpus)
    assert [r[:2] for r in rows(table)] == [
        ("one", "my dir/b+c.py"), ("one", "src/__init__.py"), ("one", "src/a.py"), ("two", "a.go"),
    ]
    assert rows(files.read_source_files(spark, f"{corpus}/two", repo_id="x").select("repo_id", "path")) == [("x", "a.go")]
    assert files.read_source_files(spark, corpus, include_vcs=True).where("path = '.git/hook.py'").count() == 1
    one = files.read_source_files(spark, f"{corpus}/two/a.go", repo_id="x")
    assert rows(one.select("repo_id", "path")) == [("x", "a.go")]


def test_list_and_count_files(spark, corpus, rows):
    listing = files.list_files(spark, corpus)
    assert rows(files.file_counts(listing)) == [("one", 6), ("two", 2)]
    assert rows(files.file_counts(files.list_files(spark, corpus, include_vcs=False))) == [("one", 5), ("two", 2)]


def test_missing_files(make, rows):
    known = make([("r", "src/app.py")], "repo_id string, path string")
    wanted = make([("r", "app"), ("r", "none")], "repo_id string, text string")
    assert rows(files.missing_files(known, wanted)) == [("r", "none")]


def test_missing_files_by_pieces(make, rows):
    paths = [("r", p) for p in ("src/main.py", "src/src/src.c", "a", "é/ü.py", "aaaa", "")] + [("s", "other.py"), ("s", None)]
    texts = ["src", "src/s", "main.py", "src.cc", "aaa", "aaaaa", "é/", "ü.p", "ü.c", "a", "", "x", "zz", None, "src", "other.py"]
    wanted = [(repo, text) for repo in "rst" for text in texts]
    held = {(repo, text) for repo, text in wanted if text is not None and any(q == repo and p and text in p for q, p in paths)}
    found = files.missing_files(make(paths, "repo_id string, path string"), make(wanted, "repo_id string, text string"))
    assert rows(found.select("repo_id", "text")) == sorted((w for w in wanted if w not in held), key=lambda w: tuple(map(str, w)))


def test_read_history(spark, tmp_path, rows):
    text = (
        "COMMIT:h1:a@x:100\n1\t2\tsrc/a.py\n-\t-\timg.png\n\nCOMMIT:h2:b:odd@x:200\n\nx\t2\ta.py\n1\ta.py\n"
        "3\t0\tsrc/{a => b}/c.py\n 5\t6\tpadded.py \n\nCOMMIT:h3:c@x:300\n\nCOMMIT:h4::400\n7\t8\tz\n"
    )
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "repo.one.log").write_text(text)
    table = history.parse_history(history.read_history(spark, str(tmp_path / "logs")))
    second = lambda n: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=n)
    assert rows(table) == [
        ("repo.one", "h1", "a@x", second(100), "src/a.py", 1, 2),
        ("repo.one", "h2", "b", second(200), "padded.py", 5, 6),
        ("repo.one", "h2", "b", second(200), "src/{a => b}/c.py", 3, 0),
        ("repo.one", "h4", "", second(400), "z", 7, 8),
    ]
    (tmp_path / "parts" / "repo_id=7").mkdir(parents=True)
    (tmp_path / "parts" / "repo_id=7" / "x").write_text("COMMIT:h:a:1\n1\t1\tp")
    assert history.parse_history(history.read_history(spark, str(tmp_path / "parts"))).first().repo_id == "7"


def test_hidden_logs_and_equal_names(spark, tmp_path):
    for path in (".github.log", "_tools.log", "ok.log", "org1/app.log", "org2/app.log", "org2/.x/a+b c.log", "org1/._y.log"):
        file = tmp_path / "logs" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"COMMIT:h1:a@x:100\n1\t2\t{path}\n\nCOMMIT:h2:b@x:200\n3\t4\t{path}\n")
    table = history.parse_history(history.read_history(spark, str(tmp_path / "logs")))
    got = sorted((r.repo_id, r.commit_hash) for r in table.collect())
    repos = [".github", "_tools", "ok", "org1/app", "org2/app", "org2/.x/a+b c", "org1/._y"]
    assert got == sorted((r, h) for r in repos for h in ("h1", "h2"))
    only_hidden = history.read_history(spark, str(tmp_path / "logs" / "org2" / ".x"))
    assert [r.repo_id for r in only_hidden.select("repo_id").distinct().collect()] == ["a+b c"]


@pytest.mark.parametrize("name", ["app.log", "_app.log"])
@pytest.mark.parametrize("size", [1, 7, 40, 1000, 1 << 20])
def test_commits_that_span_splits(spark, tmp_path, rows, monkeypatch, name, size):
    """Headers reach their lines over any number of splits, also splits without a header or a line."""
    commits, text = [], "1\t1\tbefore any header\n"
    for c, n in enumerate([3, 0, 60, 1, 0, 0, 25]):
        text += f"COMMIT:h{c}:a{c}@x:{c}\n" + "".join(f"{i}\t{c}\tsrc/{'x' * (i % 5)}{i}.py\n" for i in range(n)) + "\n"
        commits += [(f"h{c}", f"a{c}@x", f"src/{'x' * (i % 5)}{i}.py", i, c) for i in range(n)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / name).write_text(text.rstrip("\n"))
    (tmp_path / "logs" / "empty.log").write_text("")
    (tmp_path / "logs" / ("x" + name)).write_text("COMMIT:other:b@x:9\n5\t6\tz\n")
    monkeypatch.setattr(history, "SPLIT_BYTES", size)
    monkeypatch.setattr(history, "_CHUNK", 64)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", max(size, 40))
    try:
        read = history.read_history(spark, str(tmp_path / "logs"))
        table = history.parse_history(read).where("commit_hash <> 'other'")
        got = rows(table.select("commit_hash", "author_email", "path", "added", "removed"))
        assert history.parse_history(read).where("commit_hash = 'other'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(commits, key=lambda row: tuple(map(str, row)))


def test_repositories_are_named_once_per_log(spark, tmp_path, rows):
    """No line is put through an address decoder or a pattern to find the repository of its log."""
    for i, name in enumerate(["a b+c.log", "100%25.x.log", "repo_id=q/part", "deep/é.txt"]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"COMMIT:h{i}:a@x:1\n1\t2\tf{i}\n")
    lines = history.read_history(spark, str(tmp_path))
    assert "decode" not in lines._jdf.queryExecution().optimizedPlan().toString()
    want = [("a b+c", "h0"), ("100%25.x", "h1"), ("q", "h2"), ("deep/é", "h3")]
    assert rows(lines) == sorted((repo, f"COMMIT:{h}:a@x:1", f"1\t2\tf{h[1]}") for repo, h in want)


def test_only_missing_and_denied_files_are_passed_over(tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    read = files._read_contents(str(tmp_path))
    listed = lambda *names: iter([pd.DataFrame(
        {"repo_id": "r", "path": list(names), "location": [str(tmp_path / n) for n in names]}
    )])
    found = pd.concat(read(listed("a.py", "gone.py")))
    assert list(found["content"]) == [b"x = 1", None]
    assert found["problem"][0] is None and found["problem"][1].startswith("FileNotFoundError")
    with pytest.raises(OSError):  # any other error fails the task
        list(read(listed("")))


def test_addresses_of_stores():
    for scheme in ("s3", "s3a", "s3n"):
        system, path = files.file_system(f"{scheme}://bucket/logs?region=eu-west-1")
        assert (system.type_name, path) == ("s3", "bucket/logs")


def test_window_ends(make):
    stamps = [dt.datetime(2024, 6, 30, 9), dt.datetime(2024, 7, 1), dt.datetime(2024, 1, 30), dt.datetime(2023, 12, 30, 12)]
    frame = make([(t,) for t in stamps], "t timestamp_ntz")
    kept = lambda as_of: [r.t for r in frame.where(in_window(F.col("t"), as_of, 6)).collect()]
    assert kept("2024-06-30") == kept(dt.date(2024, 6, 30)) == [stamps[0], stamps[2], stamps[3]]
    assert kept("2024-06-30 08:00:00") == kept(dt.datetime(2024, 6, 30, 8)) == [stamps[2], stamps[3]]


def test_usage_log_evolves(spark, tmp_path, make):
    folder = str(tmp_path / "analyses")
    old = make([(1, "u", "n", AT)], "id long, repo_url string, repo_name string, timestamp timestamp_ntz")
    old.write.parquet(folder)
    usage_log.append_analyses(old.withColumns({"id": F.lit(2), "graph_nodes": F.lit(7)}), folder)
    table = usage_log.read_analyses(spark, folder)
    assert table.schema.simpleString() == ANALYSES.simpleString()
    assert {r.id: r.graph_nodes for r in table.collect()} == {1: 0, 2: 7}
    usage_log.export_analyses(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ANALYSES.names and back.count() == 2


def test_leads_need_a_contact(spark, tmp_path):
    leads = b.bind(spark, SF, b.LEADS)
    usage_log.append_leads(leads, str(tmp_path / "leads"))
    stored = usage_log.read_leads(spark, str(tmp_path / "leads"))
    assert stored.schema.simpleString() == LEADS.simpleString()
    assert 0 < stored.count() == leads.where("email is not null or linkedin is not null").count() < leads.count()
    usage_log.export_leads(stored, str(tmp_path / "csv"))
    times = [r.timestamp for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()]
    assert times == sorted(times, reverse=True)


def test_urls(make, rows):
    texts = [" https://github.com/a/b// ", "https://github.com/é/B.c-d", "http://github.com/a/b", "https://github.com/a/b/c",
             "\thttps://github.com/A/B\n", "https://github.com/a/"]
    found = usage.valid_repo_urls(make([(t,) for t in texts], "url string"))
    got = {r.repo_url: (r.owner, r.repo_name, r.cache_key) for r in found.collect()}
    assert set(got) == {"https://github.com/a/b", "https://github.com/é/B.c-d", "https://github.com/A/B"}
    assert got["https://github.com/a/b"][2] == got["https://github.com/A/B"][2]
    assert got["https://github.com/é/B.c-d"][:2] == ("é", "B.c-d")


def test_popularity_stream_matches_batch(spark, tmp_path, rows):
    log = usage_log.merge_analyses(b.bind(spark, SF, b.ANALYSES))
    feed_folder, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for part in (log.where("id % 2 = 0"), log.where("id % 2 = 1")):
        part.write.mode("append").parquet(feed_folder)
        query = usage_feed.keep_popularity(usage_feed.stream_analyses(spark, feed_folder), out, str(tmp_path / "cp"))
        assert query.awaitTermination(120)
    assert rows(usage_feed.read_popularity(spark, out)) == rows(usage.repo_popularity(log))


def test_published_batches(spark, tmp_path, make, rows):
    out, schema = str(tmp_path), "repo_url string, repo_name string, analysis_count long, last_analyzed timestamp_ntz"
    assert usage_feed.read_popularity(spark, out).count() == 0
    usage_feed.publish(make([("a", "x", 1, AT), ("b", "x", 1, AT)], schema), 0, out, 2)
    usage_feed.publish(make([("a", "y", 2, AT)], schema), 1, out, 2)
    wanted = [("a", "y", 2, AT), ("b", "x", 1, AT)]
    assert rows(usage_feed.read_popularity(spark, out)) == wanted
    assert (tmp_path / "tables" / "1" / "_SUCCESS").exists()
    usage_feed.publish(make([("a", "replayed", 9, AT)], schema), 1, out, 2)
    usage_feed.publish(make([("c", "z", 1, AT)], schema), 2, out, 2)
    assert rows(usage_feed.read_popularity(spark, out)) == [*wanted, ("c", "z", 1, AT)]
    # A batch that broke off half-way is not seen until it is run again.
    (tmp_path / "changes" / "2" / "_SUCCESS").unlink()
    assert rows(usage_feed.read_popularity(spark, out)) == wanted
    usage_feed.publish(make([("c", "z", 1, AT)], schema), 2, out, 2)
    assert rows(usage_feed.read_popularity(spark, out)) == [*wanted, ("c", "z", 1, AT)]


def test_repeated_appends_count_once(spark, tmp_path, make):
    folder = str(tmp_path / "analyses")
    narrow = make([(1, "u", "n", AT, 5)], "id int, repo_url string, repo_name string, timestamp timestamp_ntz, duration_seconds int")
    narrow.write.parquet(folder)
    for batch in ("x", "x", None, None):
        usage_log.append_analyses(narrow.withColumn("id", F.lit(2)), folder, batch)
    usage_log.append_analyses(narrow.where("false"), folder, "empty")
    table = usage_log.read_analyses(spark, folder)
    assert sorted(r.id for r in table.collect()) == [1, 2, 2, 2]
    assert table.schema.simpleString() == ANALYSES.simpleString() and table.agg(F.sum("duration_seconds")).first()[0] == 20.0


@pytest.fixture(scope="module")
def analysis(spark):
    tags = b.bind(spark, SF, b.TAGS)
    repos = tags.select("repo_id").distinct().select(
        "repo_id", F.concat(F.lit("https://github.com/o/"), "repo_id").alias("repo_url"), F.col("repo_id").alias("repo_name")
    )
    return pipelines.analyze(tags, b.bind(spark, SF, b.COMMIT_FILES), repos, b.AS_OF), repos


def test_report(spark, tmp_path, analysis):
    found, _ = analysis
    results.write_report(found, str(tmp_path))
    for section, columns in results.REPORT_COLUMNS.items():
        table = spark.read.option("header", True).csv(str(tmp_path / section))
        assert table.columns == ["repo_id", *[heading for _, heading in columns]]
        assert table.count() == found[section].count() > 0


def test_result_store_and_json(spark, tmp_path, analysis):
    found, repos = analysis
    documents = results.result_documents(found)
    results.write_json(documents, str(tmp_path / "json"))
    first = json.loads(spark.read.text(str(tmp_path / "json" / "section=summary")).first().value)
    assert set(json.loads(first["doc"])) == {"repo_name", "repo_url", "file_count", "sizes", "churn"}
    store = str(tmp_path / "store")
    results.store_results(documents, repos, store, AT)
    results.store_results(documents.where("section = 'summary'"), repos, store, AT + dt.timedelta(days=1))
    latest = results.latest_results(results.read_results(spark, store))
    assert latest.count() == repos.count()
    broken = documents.where("section = 'summary'").withColumn("doc", F.lit("{broken"))
    results.store_results(broken, repos, store, AT + dt.timedelta(days=2))
    assert results.latest_results(results.read_results(spark, store)).count() == repos.count()
    whole = results.read_results(spark, store).count()
    results._write_run(results.read_results(spark, store).drop("run"), store, "broken off")
    assert results.read_results(spark, store).count() == whole
    for _ in range(2):
        results.store_results(documents, repos, store, AT + dt.timedelta(days=3), "again")
    assert results.read_results(spark, store).count() == whole + documents.count()
    latest = results.latest_results(results.read_results(spark, store))
    kept = sorted(map(str, latest.collect()))
    results.compact_results(spark, store)
    assert sorted(map(str, results.read_results(spark, store).collect())) == kept
    requests = usage.valid_repo_urls(repos.select(F.concat("repo_url", F.lit("/")).alias("url")).union(
        spark.createDataFrame([("https://github.com/o/new",)], "url string")))
    assert [r.repo_name for r in usage.new_repos_only(requests, latest).collect()] == ["new"]
    assert usage.known_repos(requests, latest).count() == repos.count()


def test_analysis_records(analysis):
    found, repos = analysis
    records = usage.analysis_records(found["summary"], repos, AT, 1.239)
    row = records.orderBy("repo_name").first()
    assert records.schema.simpleString() == ANALYSES.simpleString() and row.timestamp == AT and row.duration_seconds == 1.24
    assert row.graph_edges > 0 and row.top_ranked_file
    cached = usage.analysis_records(usage.cached_summary(found["summary"]), repos, AT).first()
    assert (cached.graph_edges, cached.duration_seconds) == (0, 0.0)


def test_pipelines_from_source_text(spark, corpus, tmp_path, rows):
    source = files.read_source_files(spark, corpus)
    listed = pipelines.ranked_tag_list(source)
    assert [(r.repo_id, r.section, r.file, r.ident) for r in listed.collect()] == [
        ("one", 1, "my dir/b+c.py", "b"), ("one", 1, "src/__init__.py", "start"), ("one", 2, "src/a.py", None),
        ("two", 1, "a.go", "main"),
    ]
    from stratalens.operators.text import write_repo_map

    blocks = pipelines.repo_map_blocks(source)
    assert rows(blocks) == [
        ("one", "my dir/b+c.py", "my dir/b+c.py:\ndef b(): pass"),
        ("one", "src/__init__.py", "src/__init__.py:\ndef start(): pass"), ("one", "src/a.py", "src/a.py"),
        ("two", "a.go", "a.go:\nfunc main() {}"),
    ]
    write_repo_map(blocks, str(tmp_path / "map"))
    assert spark.read.text(str(tmp_path / "map" / "repo_id=two")).count() == 3


def test_tree(make, rows):
    symbols = make([("r", "a\\b\\x.py", 1, "K"), ("r", "a/y.py", 2, "k"), ("r", "a/y.py", 3, "m"), ("r", "z.py", 0, "n")],
                   "repo_id string, path string, line int, name string")
    nodes = tree.symbol_tree(symbols)
    got = [(r.path, r.parent, r.depth, r.node_type, r.symbol_count) for r in tree.in_tree_order(nodes).collect()]
    assert got == [
        ("a", "", 0, "dir", 3), ("z.py", "", 0, "file", 1), ("a/b", "a", 1, "dir", 1), ("a/y.py", "a", 1, "file", 2),
        ("a/b/x.py", "a/b", 2, "file", 1),
    ]
    hits = lambda text: sorted(r.path for r in tree.symbol_search(nodes, symbols, text).collect())
    assert hits("k") == ["a", "a/b", "a/b/x.py", "a/y.py"]
    assert hits("Z.P") == ["z.py"]


def test_ancestors_of_a_top_level_file(make):
    frame = make([("x.py",), ("a/b/c",)], "p string").select(paths.ancestors(F.col("p")).alias("up"), paths.parent_path(F.col("p")).alias("in"))
    assert [tuple(r) for r in frame.collect()] == [([], ""), (["a", "a/b"], "a/b")]
