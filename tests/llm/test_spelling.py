"""Spelling variants against pairwise comparison; the composed machine against all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from stratalens.llm import queries, spelling_fst as fst


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_words(rows):
    counts = Counter()
    for r in rows:
        for found in regex.findall(r"[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in found)
            code = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if code % 31 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(words):
    near = {w: [] for w in words}
    listed = sorted(words)
    for i, u in enumerate(listed):
        for v in listed[i + 1 :]:
            if abs(len(u) - len(v)) < 2 and one_edit(u, v):
                near[u].append(v)
                near[v].append(u)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    result = []
    for w in listed:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return result


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
def test_words(table, request):
    docs = request.getfixturevalue(table)
    got = {r["word"]: r["n"] for r in fst.count_words(docs).collect() if r["n"] >= 2}
    assert got == brute_words(docs.collect())


@pytest.mark.parametrize("table", ["odd", "repeated", "none"])
def test_variants_of_tables(table, request):
    docs = request.getfixturevalue(table)
    assert sorted(map(tuple, fst.spelling_variants(docs).collect())) == brute_variants(brute_words(docs.collect()))


def vocabulary(seed, letters, count, longest=12):
    """Words of few letters and their slips, with counts that make chains of forms."""
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, longest)))
        words[w] = rng.choice([2, 3, 50, 1000, 20000])
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
            if len(w) >= 7:
                words.setdefault(w, rng.choice([2, 3, 50, 1000, 20000]))
    return words


@pytest.mark.parametrize("letters,count", [("ab", 250), ("abcdé", 400), ("aÿß÷", 300)])
@pytest.mark.parametrize("state_letters", [20, fst.STATE_LETTERS])
def test_dense_vocabularies(spark, letters, count, state_letters):
    """With 20 letters a state, nearly all states are cut again and again."""
    words = vocabulary(count, letters, count)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, fst.variants(table, state_letters=state_letters).collect())) == brute_variants(words)


def test_small_chunks_change_nothing(spark, monkeypatch):
    words = vocabulary(9, "abc", 300)
    rows = fst._initial_states(spark.createDataFrame(list(words.items()), "word string, n long"))
    table = rows.orderBy("key", "rest").toArrow()
    found = []
    for letters, batch in ((1, 3), (200, 7), (10**9, 10_000)):
        monkeypatch.setattr(fst, "CHUNK_LETTERS", letters)
        tables = list(fst._whole_states(iter(table.to_batches(batch))))
        keys = [k for t in tables for k in sorted(set(t["key"].to_pylist()))]
        assert len(keys) == len(set(keys)) and sum(t.num_rows for t in tables) == table.num_rows
        counts = Counter()
        for t in tables:
            part = fst._near_of_chunk(t)
            for w, n in zip(part["word"].to_pylist(), part["n_near"].to_pylist()):
                counts[w] += n
        found.append(counts)
    assert found[0] == found[1] == found[2] and found[0]


def test_composition_against_all_pairs():
    rng = random.Random(2)
    for t in range(150):
        rows = sorted(
            {(rng.randint(0, 2), "".join(rng.choice("ab" if t % 2 else "abcé") for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 60))}
        )
        codes, length = fst._letters([w for _, w in rows])
        u, v = fst.accepted_pairs(np.array([k for k, _ in rows]), codes, length)
        want = [
            (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and one_edit(rows[i][1], rows[j][1])
        ]
        assert sorted(tuple(sorted(p)) for p in zip(u.tolist(), v.tolist())) == want


def test_the_acceptor_is_minimal():
    """Words with the same endings share their states: prefixes a..d times the same endings need no more than one prefix does."""
    endings = ["ing", "ed", "er", "ers"]
    many = sorted(p + e for p in "abcd" for e in endings)
    one = sorted("a" + e for e in endings)
    sizes = []
    for words in (many, one):
        codes, length = fst._letters(words)
        sizes.append(len(fst.Acceptor(np.zeros(len(words), dtype=np.int64), codes, length).final))
    assert sizes[0] == sizes[1]


def test_a_very_long_word(spark):
    long = "ab" * 20_000
    words = {long: 500, long + "x": 3, "b" + long: 2, long[1:]: 4, "unrelated": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: r for r in fst.variants(table).collect()}
    assert [got[w]["n_near"] for w in (long, long + "x", "b" + long, long[1:], "unrelated")] == [3, 1, 1, 1, 0]
    assert got["b" + long]["root"] == long and got[long[1:]]["form_n"] == 500


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Similarity similarity similarly", "x", 5, "y")] * 3, "doc_id long, text string, word string, n int, key string")
    assert sorted(map(tuple, fst.spelling_variants(docs).collect())) == brute_variants(brute_words(docs.collect()))


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(map(tuple, queries.op12_variant_machine(spark, "/root/testdata/sf0.001").collect()))
    assert got == brute_variants(brute_words(docs))
