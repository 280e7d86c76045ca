"""Near duplicates and nearest neighbours against brute force."""

import random

import numpy as np
import pytest

from stratalens.llm import hilbert_ann, jaccard_forest


def shingles(text, size=5):
    words = (text or "").encode().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_near(rows):
    """Links between all rows, and classes of the ids."""
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[x] = y
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return links, [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("table,options", [("odd", {}), ("odd", {"small": 1, "block": 2}), ("documents", {"small": 2, "block": 8}), ("none", {})])
def test_near_duplicates(table, options, request):
    docs = request.getfixturevalue(table)
    got = {r["doc_id"]: r for r in jaccard_forest.near_duplicates(docs, **options).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(rows)
    links, classes = brute_near(rows)
    for (d, _), n, c in zip(rows, links, classes):
        assert (got[d]["n_links"], got[d]["class_id"]) == (n, c)


def test_repeated_rows_are_copies(repeated):
    got = jaccard_forest.near_duplicates(repeated).collect()
    assert len(got) == repeated.count()
    assert {r["class_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}


@pytest.mark.parametrize("options", [{}, {"small": 1, "block": 2}])
def test_rows_without_or_with_reused_ids(spark, options):
    """Null ids link like others, also where a text has no other row; different texts of one id are told apart; one row of
    each class stays."""
    rng = random.Random(7)
    a, b, c, d = ([f"{x}{rng.randrange(10**6)}" for _ in range(80)] for x in "abcd")
    near = lambda words, at: " ".join([*words[:at], "other", *words[at + 1 :]])
    a, b, c, d, e = " ".join(a), near(a, 20), near(a, 60), " ".join(b), " ".join(c)
    f, g = near(e.split(), 0), " ".join(d_ for d_ in reversed(d.split()))
    rows = [
        (None, a), (None, a), (None, b), (None, c),  # a class without any id
        (5, d), (5, d), (5, e), (None, near(d.split(), 3)),  # repeated rows, and two texts of one id
        (9, f), (3, near(d.split(), 79)), (None, f), (5, g),
        (1, ""), (1, ""), (None, None), (None, ""),
    ]
    links, _ = brute_near([(0, t) for _, t in rows])
    names = [None] * 4 + [3, 3, 5, 3, 5, 3, 5, 5, 1, 1, None, None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_forest.near_duplicates(docs, **options).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = [(i, n, k) for (i, _), n, k in zip(rows, names, links)]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=key) == sorted(want, key=key)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_forest.one_of_each(docs, **options).collect()]
    assert sum(i is None and t in (a, b, c) for i, t in kept) == 1
    rest = [(i, t or "") for i, t in kept if t not in (a, b, c)]
    want = [(3, near(d.split(), 79)), (5, e), (5, g), (1, ""), (None, ""), (None, "")]
    assert sorted(rest, key=key_text) == sorted(want, key=key_text)


def key_text(row):
    return row[0] is not None, row[0] or 0, row[1]


@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_one_row_of_each_class_stays(table, request):
    docs = request.getfixturevalue(table)
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()})
    want = [d for (d, _), c in zip(rows, brute_near(rows)[1]) if d == c]
    kept = jaccard_forest.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_large_group_in_blocks(spark):
    """A group of near copies far larger than a block: counts are exact, the class is whole."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_forest.near_duplicates(docs, small=4, block=16).collect()}
    links, classes = brute_near(rows)
    assert [got[i]["n_links"] for i in range(120)] == links
    assert [got[i]["class_id"] for i in range(120)] == classes


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in jaccard_forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 99: 98, 100: 98}


def test_depth_gives_the_recall():
    depth = jaccard_forest.depth_for(0.8)
    reach = lambda d: 1 - (1 - 0.8**d) ** jaccard_forest.TREES
    assert reach(depth) >= jaccard_forest.RECALL > reach(depth + 1)


def test_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 4, indexing="ij"), -1).reshape(-1, 4)
    keys = hilbert_ann.curve_keys(cells, 2)
    path = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(256))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_nearest(rows, every, k):
    rows = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    out = {}
    for q, x in rows.items():
        if q % every == 0:
            scored = [(-float(x @ v) / (np.linalg.norm(x) * np.linalg.norm(v)), i) for i, v in rows.items() if i != q]
            scored = sorted((round(s, 12), i) for s, i in scored)
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def check_nearest(frame, rows, every, k):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {q: n for q, n in brute_nearest(rows, every, k).items() if n}
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [x[:2] for x in got[q]] == [x[:2] for x in near]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in near], abs=1e-11)


def test_nearest_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(60)]
    rows += [(i, rows[7][1]) for i in range(100, 140)]  # many copies
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (7, rows[7][1]), (300, [2.0 * x for x in rows[3][1]])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rep string")
    check_nearest(hilbert_ann.nearest(frame, every=10), rows, 10, 5)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    check_nearest(hilbert_ann.nearest(few, every=1), rows[:3], 1, 5)
    assert hilbert_ann.nearest(frame.where("false")).count() == 0


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in frame.collect()]
    want = {(q, i) for q, near in brute_nearest(rows, 50, 5).items() for _, i, _ in near}
    got = {(r["query_id"], r["vec_id"]) for r in hilbert_ann.nearest(frame, window=32).collect()}
    assert len(want & got) >= 0.9 * len(want)
