"""Graph and rank: hand cases, invariants, and the edge-list form as a second way to the same ranks."""

import math

import pytest
from pyspark.sql import functions as F

from stratalens import bindings as b
from stratalens.operators import graph, rank

TAGS = "repo_id string, path string, line int, name string, kind string"
SF = "/root/testdata/sf0.001"


def brute_force(tags, damping=0.85, tolerance=1e-6, max_rounds=100):
    """Ranks of one repository from its edge list: {file: rank}, and {(file, ident): rank}."""
    defs = {(name, path) for path, _, name, kind in tags if kind == "def"}
    refs = {}
    for path, _, name, kind in tags:
        if kind == "ref":
            refs[name, path] = refs.get((name, path), 0) + 1
    if not refs:
        refs = {key: 1 for key in defs}
    edges = [
        (src, dst, name, (0.1 if name.startswith("_") else 1.0) * math.sqrt(count))
        for (name, src), count in refs.items()
        for other, dst in defs
        if other == name
    ]
    nodes = {end for edge in edges for end in edge[:2]}
    out = {n: sum(e[3] for e in edges if e[0] == n) for n in nodes}
    ranks = {n: 1 / len(nodes) for n in nodes}
    for _ in range(max_rounds):
        lost = sum(ranks[n] for n in nodes if out[n] == 0)
        new = {n: (1 - damping) / len(nodes) + damping * lost / len(nodes) for n in nodes}
        for src, dst, _, w in edges:
            new[dst] += damping * ranks[src] * w / out[src]
        change = sum(abs(new[n] - ranks[n]) for n in nodes)
        ranks = new
        if change < len(nodes) * tolerance:
            break
    spread = {}
    for src, dst, name, w in edges:
        spread[dst, name] = spread.get((dst, name), 0) + ranks[src] * w / out[src]
    return ranks, spread, edges


# A chain that needs many rounds, a dense pair, and a repository without references.
def chain(repo, size):
    rows = []
    for i in range(size):
        rows.append((repo, f"f{i:02}.py", 1, f"n{i}", "def"))
        if i + 1 < size:
            rows += [(repo, f"f{i:02}.py", 2, f"n{i + 1}", "ref")] * (i % 3 + 1)
    return rows + [(repo, "f03.py", 3, "n0", "ref"), (repo, "f01.py", 4, "_p", "def"), (repo, "f02.py", 4, "_p", "ref")]


MIXED = (
    chain("long", 17)
    + chain("short", 4)
    + [("pair", "a", 0, "x", "def"), ("pair", "b", 0, "x", "ref"), ("pair", "b", 1, "y", "def"), ("pair", "a", 1, "y", "ref")]
    + [("quiet", "a", 0, "x", "def"), ("quiet", "b", 0, "x", "def"), ("quiet", "b", 1, "y", "def")]
    + [("self", "a", 0, "x", "def"), ("self", "a", 1, "x", "ref")]
    + [("apart", "a", 0, "x", "def"), ("apart", "a", 1, "z", "ref")]
    # names that the random jump's own name might be taken for
    + [("blank", f, i, n, k) for i, (f, n, k) in enumerate([
        ("a", "", "def"), ("b", "", "ref"), ("b", "*", "def"), ("c", "*", "ref"), ("c", "=", "def"), ("a", "=", "ref"), ("b", "=", "ref")
    ])]
)


@pytest.mark.parametrize("tolerance, rounds", [(1e-6, 100), (1e-6, 7), (0.0, 3), (0.0, 12), (1e-3, 100)])
@pytest.mark.parametrize("chunk", [rank.CHUNK_ROWS, 2])
def test_ranks_equal_the_edge_list_form(make, monkeypatch, tolerance, rounds, chunk):
    """Also with every file and name split into small chunks."""
    monkeypatch.setattr(rank, "CHUNK_ROWS", chunk)
    tags = graph.keep_pairs(make(MIXED, TAGS))
    ranks = rank.rank_files(tags, tolerance=tolerance, max_rounds=rounds)
    got = {(r.repo_id, r.file): r["rank"] for r in ranks.collect()}
    spread = {(r.repo_id, r.file, r.ident): r["rank"] for r in rank.ranked_definitions(tags, ranks).collect()}
    want, want_spread = {}, {}
    for repo in {row[0] for row in MIXED}:
        own, own_spread, _ = brute_force([row[1:] for row in MIXED if row[0] == repo], 0.85, tolerance, rounds)
        want |= {(repo, f): r for f, r in own.items()}
        want_spread |= {(repo, *k): r for k, r in own_spread.items()}
    assert got == pytest.approx(want, abs=1e-12)
    assert spread == pytest.approx(want_spread, abs=1e-12)


def test_no_edges(make):
    ranks = rank.rank_files(graph.tag_pairs(make([("apart", "a", 0, "x", "def"), ("apart", "a", 1, "z", "ref")], TAGS)))
    assert ranks.count() == 0
    assert rank.ranked_files(ranks).count() == 0


def test_invariants(spark):
    tags = graph.keep_pairs(b.bind(spark, SF, b.TAGS))
    ranks = rank.rank_files(tags)
    for row in ranks.groupBy("repo_id").agg(F.sum("rank").alias("total")).collect():
        assert row.total == pytest.approx(1, abs=1e-12)
    sources = graph.file_degrees(tags).where("out_degree > 0").select("repo_id", "file")
    carried = {r.repo_id: r.s for r in ranks.join(sources, ["repo_id", "file"]).groupBy("repo_id").agg(F.sum("rank").alias("s")).collect()}
    spread = rank.ranked_definitions(tags, ranks).groupBy("repo_id").agg(F.sum("rank").alias("s"))
    assert {r.repo_id: r.s for r in spread.collect()} == pytest.approx(carried, abs=1e-12)
    degrees = graph.file_degrees(tags).agg(F.sum(F.col("out_degree") + F.col("in_degree"))).first()[0]
    assert degrees == 2 * graph.dependency_edges(tags).count()


def test_private_names_and_single_node(make, rows):
    tags = make([("r", "a", 0, "_x", "def")] + [("r", "b", 0, "_x", "ref")] * 4, TAGS)
    assert rows(graph.dependency_edges(graph.tag_pairs(tags))) == [("r", "b", "a", "_x", pytest.approx(0.2))]
    alone = make([("r", "a", 0, "x", "def"), ("r", "a", 1, "x", "ref")], TAGS)
    assert rows(graph.degree_centrality(graph.tag_pairs(alone))) == [("r", "a", 1.0)]


def test_equal_ranks_order_by_last_name_first(make, rows):
    tags = make([("r", p, 0, "x", "def") for p in "abc"], TAGS)
    ranked = rank.ranked_files(rank.rank_files(graph.tag_pairs(tags))).select("rank_position", "file")
    assert rows(ranked) == [(1, "c"), (2, "b"), (3, "a")]


def test_bare_files_follow_ranked_tags(make, rows):
    tags = make([("r", "a", 5, "x", "def"), ("r", "a", 9, "x", "def"), ("r", "b", 0, "x", "ref")], TAGS)
    pairs = graph.keep_pairs(tags)
    listed = rank.in_tag_order(rank.ranked_tags(tags, pairs, rank.rank_files(pairs)))
    got = [(r.section, r.file, r.ident, r.line) for r in listed.collect()]
    assert got == [(1, "a", "x", 5), (1, "a", "x", 9), (2, "b", None, None)]


def test_subgraph_hides_self_references(make, rows):
    tags = make([("r", "a", 0, "x", "def"), ("r", "a", 1, "x", "ref"), ("r", "b", 1, "x", "ref"), ("r", "c", 1, "x", "ref")], TAGS)
    nodes = make([("r", "a"), ("r", "b")], "repo_id string, file string")
    assert rows(graph.subgraph_edges(graph.tag_pairs(tags), nodes)) == [("r", "b", "a", "x", 1.0)]


def test_collapsed_edges_name_at_most_five(make, rows):
    tags = make([("r", "a", 0, f"n{i}", "def") for i in range(8)] + [("r", "b", 0, f"n{i}", "ref") for i in range(8)], TAGS)
    assert rows(graph.collapse_edges(graph.dependency_edges(graph.tag_pairs(tags)))) == [("r", "b", "a", 8.0, ["n0", "n1", "n2", "n3", "n4"])]


@pytest.mark.parametrize("side", [2, 5])
def test_cells_of_hot_names(spark, make, rows, monkeypatch, side):
    """Any cut of a name's product gives the plain join's edges; no cell is larger than its sides allow for."""
    monkeypatch.setattr(graph, "CELL_SIDE", side)
    monkeypatch.setattr(graph, "SALTS", 3)
    tags = make(
        [("r", f"f{i}", 1, "hot", kind) for i in range(17) for kind in ("ref", "def") if kind == "ref" or i % 3 == 0]
        + [("r", "a", 1, "cold", "def"), ("r", "b", 1, "cold", "ref"), ("r", "b", 1, "lost", "ref"), ("q", "a", 1, "hot", "def")],
        "repo_id string, path string, line int, name string, kind string",
    )
    pairs = graph.keep_pairs(tags)
    plain = graph._edges(graph.ref_counts(pairs), graph.definers(pairs))
    assert rows(graph.dependency_edges(pairs)) == rows(plain)
    refs, defs = graph.linked_pairs(pairs)
    assert rows(graph.file_degrees(pairs)) == rows(graph.degrees_of(refs, defs))


def test_degrees_take_few_shuffles(spark, tmp_path):
    schema = "repo_id string, name string, path string, ref_count bigint, is_defined boolean"
    spark.createDataFrame([("r", "n", "a", 1, True)], schema).write.parquet(str(tmp_path / "pairs"))
    degrees = graph.file_degrees(spark.read.parquet(str(tmp_path / "pairs")))
    plan = degrees._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 3 and plan.count("Join") == 2


def test_degrees_look_names_up_unsorted(spark, make, rows):
    """Pairs are not sorted for the lookup, and only names that someone defines are looked up; linked names take one sum by name."""
    pairs = make(
        [("r", "a", "f", 2, True), ("r", "a", "g", 1, False), ("r", "b", "g", 1, False), ("r", None, "f", 1, True),
         (None, "a", "f", 1, True), ("s", "c", "h", 0, True), ("s", "d", "h", 0, False)],
        "repo_id string, name string, path string, ref_count long, is_defined boolean",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        degrees = graph.file_degrees(pairs)
        assert "ShuffledHashJoin" in degrees._jdf.queryExecution().sparkPlan().toString()
        assert rows(degrees) == [("r", "f", 1, 2), ("r", "g", 1, 0), ("s", "h", 1, 1)]
        linked = graph.linked_names(pairs)
        assert linked._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 2
        assert rows(linked) == [("r", "a"), ("s", "c")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
