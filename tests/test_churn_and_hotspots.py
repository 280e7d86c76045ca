import datetime as dt

import pytest

from stratalens import bindings as b
from stratalens.operators import churn as ch
from stratalens.operators import hotspots as hs
from stratalens.schemas import COMMIT_FILES

RANKED = "repo_id string, rank_position int, file string, pagerank_score double, centrality double"


@pytest.fixture
def commits(make):
    def build(*entries):
        rows = [
            ("r", h, a, dt.datetime.fromisoformat(t), p, added, removed) for h, a, t, p, added, removed in entries
        ]
        return make(rows, COMMIT_FILES)

    return build


def churn_rows(make, *rows):
    return make([("r", i + 1, *row) for i, row in enumerate(rows)],
                "repo_id string, position int, filename string, commits long, total_churn long")


def test_month_end_window_and_binary_files(commits):
    table = commits(
        ("h1", "a", "2023-02-27", "x", 1, 1), ("h2", "a", "2023-02-28", "x", 1, 1),
        ("h3", "a", "2023-08-31", "x", 1, 1), ("h4", "a", "2023-09-01", "x", 1, 1), ("h5", "a", "2023-08-01", "x", None, None),
    )
    window = ch.history_window(table, "2023-08-31", 6)
    assert sorted(r.commit_hash for r in window.collect()) == ["h2", "h3"]
    assert ch.churn_totals(window, dt.date(2023, 8, 31), 6).first().period == "2023-02-28 to 2023-08-31"


def test_window_reaches_the_scan(spark, tmp_path, commits):
    commits(("h1", "a", "2023-02-27", "x", 1, 1)).write.parquet(str(tmp_path / "t"))
    window = ch.history_window(spark.read.schema(COMMIT_FILES).parquet(str(tmp_path / "t")), "2023-08-31", 6)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(commit_ts" in plan and "LessThanOrEqual(commit_ts" in plan


def test_churn_metrics(commits):
    window = commits(
        ("h1", "a", "2023-01-01", "x", 10, 0), ("h2", "b", "2023-01-02", "x", 0, 5), ("h3", "", "2023-01-03", "x", 1, 1),
        ("h3", "", "2023-01-03", "y", 1, 1), ("h4", "a", "2023-01-04", "y", 1, 1), ("h5", "a", "2023-01-05", "z", 1, 1),
    )
    row = ch.churn_files(window).where("filename = 'x'").first()
    assert (row.commits, row.total_contributor, row.minor_contributor, row.total_churn) == (3, 2, 1, 17)
    assert (row.max_churn, row.avg_churn, row.avg_lines_added, row.contributor_exp) == (15, 5.67, 3.67, 58.82)


def test_ties_follow_the_log(commits):
    window = commits(
        ("h1", "a", "2023-01-01", "old", 1, 1), ("h2", "a", "2023-01-02", "m", 1, 1), ("h3", "a", "2023-01-02", "n", 1, 1),
        ("h3", "a", "2023-01-02", "k", 1, 1),
    )
    order = lambda table: [r.filename for r in table.orderBy("position").collect()]
    assert order(ch.churn_files(window)) == ["k", "n", "m", "old"]
    assert order(ch.churn_files(window, k=None)) == ["k", "n", "m", "old"]
    assert order(ch.churn_files(window, k=2)) == ["k", "n"]


def test_minor_contributors_never_exceed_contributors(spark):
    from stratalens import bindings as b

    window = ch.history_window(b.bind(spark, "/root/testdata/sf0.001", b.COMMIT_FILES), b.AS_OF, b.MONTHS)
    assert ch.churn_files(window, k=None).where("minor_contributor > total_contributor").count() == 0


def test_process_metrics_sum_a_commit_first(commits):
    window = commits(("h1", "a", "2023-01-01", "x", 4, 1), ("h1", "a", "2023-01-01", "x", 4, 1), ("h2", "b", "2023-01-02", "x", 0, 0))
    net = ch.process_metrics(window).first()
    assert (net.commits, net.Total_churn, net.Max_churn, net.Avg_churn) == (2, 6, 6, 3.0)
    assert (net.Total_contributor, net.Minor_contributor, net.Contributor_exp) == (2, 1, 100.0)
    assert ch.process_metrics(window, churn="gross").first().Max_churn == 10


def test_suffix_match_takes_the_first_row(make):
    ranked = make([("r", 1, "web/app.py", 0.6, 0.1), ("r", 2, "foo_bar.py", 0.4, 0.1), ("r", 3, "none", 0.1, 0.0)], RANKED)
    churn = churn_rows(make, ("app.py", 9, 90), ("web/app.py", 8, 80), ("bar.py", 2, 1), ("", 1, 1))
    commits = lambda df: {r.file: r.commits for r in df.collect()}
    assert commits(hs.hotspots(ranked, churn)) == {"web/app.py": 9, "foo_bar.py": 2}
    assert commits(hs.hotspots(ranked, churn, k=None)) == {"web/app.py": 9, "foo_bar.py": 2}
    assert commits(hs.hotspots(ranked, churn, match=hs.EXACT)) == {"web/app.py": 8}


def test_full_suffix_join_against_brute_force(make):
    names = ["a", "ba", "b/a", "cb/a", "c/b/a", "x.py", "lib/x.py", "slib/x.py", "é/x.py", "p/é/x.py", "zz"]
    ranked = [("r", i + 1, n, 0.5, 0.0) for i, n in enumerate(names[::2] + ["q/zz", "nothing"])]
    churn = [(n, len(n), i) for i, n in enumerate(names)]
    want = {}
    for _, _, file, *_ in ranked:
        hits = [c for c in churn if file.endswith(c[0]) or c[0].endswith(file)]
        if hits:
            want[file] = hits[0][2]
    got = hs.hotspots(make(ranked, RANKED), churn_rows(make, *churn), k=None)
    assert {r.file: r.total_churn for r in got.collect()} == want


def test_hotspot_scores_lie_in_the_unit_interval_and_ties_follow_rank(make):
    ranked = make([("r", i + 1, f"f{i}", 0.5, 0.1) for i in range(4)], RANKED)
    churn = churn_rows(make, *[(f"f{i}", 3, 3) for i in range(4)])
    found = hs.hotspots(ranked, churn).orderBy("repo_id", *hs.hotspot_order()).collect()
    assert [r.file for r in found] == ["f0", "f1", "f2", "f3"]
    assert all(0 <= r.hotspot_score <= 1 for r in found)


def test_quadrants(make):
    ranked = make(
        [("r", 1, "hh", 1.0, 0.0), ("r", 2, "edge", 0.31, 0.0), ("r", 3, "hl", 0.3, 0.0), ("r", 4, "ll", 0.1, 0.0)], RANKED
    )
    churn = churn_rows(make, ("hh", 10, 5), ("hl", 4, 5), ("edge", 3, 5))
    points = {r.file: r.quadrant for r in hs.prioritization_matrix(ranked, churn).collect()}
    assert points == {"hh": hs.HIGHEST_RISK, "edge": hs.STABLE, "hl": hs.FRAGILE, "ll": hs.SAFE}


def test_matrix_without_any_churn(make):
    ranked = make([("r", 1, "a", 0.0, 0.0)], RANKED)
    point = hs.prioritization_matrix(ranked, churn_rows(make, ("zzz", 1, 1)).limit(0)).first()
    assert (point.commits, point.x, point.y, point.quadrant) == (0, 0.0, 0.0, hs.SAFE)


def test_minor_contributors_in_the_same_pass(spark, rows):
    window = ch.history_window(b.bind(spark, "/root/testdata/sf0.001", b.COMMIT_FILES), b.AS_OF, b.MONTHS)
    once, plain = ch.file_churn_with_minors(window), ch.file_churn(window)
    assert rows(once.drop("minor_contributor")) == rows(plain) != []
    minor = once.where("minor_contributor > 0").select("repo_id", "filename", "minor_contributor")
    assert rows(minor) == rows(ch.minor_contributors(window)) != []
    assert once._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2


def test_authors_without_a_name_are_no_minor_contributors(commits, rows):
    table = commits(
        ("h1", "", "2023-07-01", "x", 1, 0), ("h2", "a", "2023-07-02", "x", 2, 0), ("h3", "a", "2023-07-03", "y", 1, 1),
        *[(f"h{i}", "b", "2023-07-04", name, 1, 0) for i, name in enumerate("xyz", 4)],
    )
    found = ch.file_churn_with_minors(table).select("filename", "commits", "total_contributor", "minor_contributor")
    assert rows(found) == [("x", 3, 2, 1), ("y", 2, 2, 1), ("z", 1, 1, 0)]
