"""Merkle manifest against a tree built whole, and the sharing of nodes between versions."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stratalens.llm import merkle_versions as mv
from stratalens.llm import queries


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, n_chars):
    values = (row["doc_id"], row["source"], row["lang"], n_chars, row["text"])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def whole_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def way(levels, pos):
    """Others on the way from leaf ``pos`` up, and a function that folds another leaf."""
    others = []
    for level in levels[:-1]:
        others.append((pos % 2, level[pos ^ 1] if (pos ^ 1) < len(level) else ""))
        pos //= 2
    return others


def fold(digest, others):
    for bit, other in others:
        digest = h(other + digest if bit else digest + other)
    return digest


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, placed = {}, {}
    for g in names:
        placed[g] = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"])))
        trees[g] = whole_tree([leaf_of(r, r["n_chars"]) for r in placed[g]])
    top = whole_tree([trees[g][-1][0] for g in names])
    result = []
    for at, g in enumerate(names):
        above = way(top, at)
        for pos, r in enumerate(placed[g]):
            others = way(trees[g], pos) + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            new = leaf_of(r, r["n_chars"] + 1 if hit and r["n_chars"] is not None else r["n_chars"])
            folded = fold(new, others)
            result.append(
                (r["doc_id"], trees[g][0][pos], trees[g][-1][0], top[-1][0], h("".join(o for _, o in others)), folded, folded == top[-1][0])
            )
    return result


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def manifest(docs, bits):
    longer = docs["n_chars"].cast("decimal(20,0)") + 1
    return mv.manifest(docs, {"n_chars": longer}, mv.tampered(docs["doc_id"]), bits=bits)


def digests(rows):
    return rows.select("doc_id", "leaf", "subroot", "root", mv.proof(rows["steps"]).alias("p"), "folded_root", "verified").collect()


@pytest.mark.parametrize("bits", [1, 3, mv.BLOCK_BITS])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_blocks_of_any_size_give_the_whole_tree(table, bits, request):
    docs = request.getfixturevalue(table)
    assert by_text(digests(manifest(docs, bits))) == by_text(brute(docs.collect()))


@pytest.mark.parametrize("bits", [4])
def test_table(documents, bits):
    assert by_text(digests(manifest(documents, bits))) == by_text(brute(documents.collect()))


@pytest.mark.parametrize("count", [0, 1, 4, 5, 17])
def test_numbers_of_leaves_around_a_block(spark, count):
    docs = spark.range(count).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("n_chars"), F.lit("é").alias("text"),
    )
    assert by_text(digests(manifest(docs, 2))) == by_text(brute(docs.collect()))


def test_nulls_and_clashing_columns(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string, steps int, root int"
    rows = [
        (i if i % 5 else None, None if i % 2 else "s", [None, "", "a", "é"][i % 4], None if i % 3 == 0 else 2**63 - 1, None if i % 7 == 0 else "t", "x", 1, "y", 2, 3)
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, schema)
    assert by_text(digests(manifest(docs, 2))) == by_text(brute(docs.collect()))


def test_empty(none):
    assert manifest(none, 2).collect() == []


def test_a_version_shares_all_but_its_ancestors():
    leaves = [h(str(i)) for i in range(11)]
    tree = mv.BlockTree(leaves)
    base = list(tree.digest)
    tops = {}
    for i in range(11):
        top, copied = tree.change(tree.top, i, h("new"))
        tops[i] = top
        assert len(copied) == tree.height + 1
        wanted = whole_tree(leaves[:i] + [h("new")] + leaves[i + 1 :])
        assert tree.digest[top] == wanted[-1][0]
        # Everything off the path is the base's own node, not a copy.
        assert [other for other, _ in tree.way(top, i)] == [other for other, _ in tree.way(tree.top, i)]
    assert tree.digest[: len(base)] == base and len(tree.digest) == len(base) + 11 * (tree.height + 1)
    # A version can be changed again: the one it comes from stays as it is.
    top, _ = tree.change(tops[3], 8, h("more"))
    assert tree.digest[top] == whole_tree([h("new") if i == 3 else h("more") if i == 8 else d for i, d in enumerate(leaves)])[-1][0]
    assert tree.digest[tops[3]] != tree.digest[top]


def test_copied_nodes_reach_the_folded_root(documents):
    for r in manifest(documents, 3).collect():
        if r["copied"]:
            assert len(r["copied"]) == len(r["steps"]) + 1 and r["copied"][-1] == r["folded_root"] and not r["verified"]
        else:
            assert r["verified"] and r["folded_root"] == r["root"]


def test_query_columns(spark):
    rows = queries.op11_path_copies(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert by_text(rows) == by_text(brute(docs))
