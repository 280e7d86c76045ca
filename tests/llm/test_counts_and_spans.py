"""Quality rules, passage removal and line removal against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from stratalens.llm import line_suffixes, quality_rules, span_graph


def brute_counts(text):
    b = (text or "").encode()
    words = b.split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, dups = b.split(b"\n"), set(), 0
    for line in lines:
        if line.split():
            dups += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in b"#*$%&|<>" for c in b), dups, len(covered)


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
def test_counts(table, request):
    docs = request.getfixturevalue(table)
    judged = quality_rules.judge(docs)
    assert judged.columns == [*docs.columns, "_quality"]
    got = [(r["text"], r["_quality"]) for r in judged.collect()]
    assert len(got) == docs.count()
    for text, q in got:
        counts = brute_counts(text)
        assert tuple(q)[:5] == counts
        assert q["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (q["base_failed"] and q["kept"])


def test_host_verdicts(spark):
    clean = " ".join(f"c{i}" for i in range(60))
    noisy = clean + " " + "#" * 200
    rows = [(i, noisy if i < 90 else clean, "bad") for i in range(100)]
    rows += [(i, clean if i < 990 else noisy, "good") for i in range(200, 1000)]
    rows += [(1000, noisy, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["_quality"] for r in quality_rules.judge(docs).collect()}
    assert [got[0]["kept"], got[95]["kept"], got[995]["kept"]] == [False, True, True]
    # one failure of one document: shrunk towards the rate of all
    assert 0.1 < got[1000]["host_rate"] < 1.0
    k, n = 101, 901
    squares = 90 * 90 / 100 + 10 * 10 / 800 + 1
    a, b = quality_rules.prior(n, k, 3, squares, quality_rules.Rules())
    assert got[0]["host_rate"] == round((90 + a) / (100 + a + b), 6)
    assert a / (a + b) == pytest.approx(k / n)


def brute_spans(rows, window):
    seen, out = {}, {}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in rows:
        words = (text or "").encode().split()
        for at in range(len(words) - window + 1):
            seen.setdefault(tuple(words[at : at + window]), (doc, at))
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for at in range(len(words) - window + 1):
            if seen[tuple(words[at : at + window])] != (doc, at):
                gone.update(range(at, at + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), kept.decode())
    return out


@pytest.mark.parametrize("table,window,anchor", [("odd", 20, 6), ("odd", 8, 3), ("repeated", 20, 6), ("documents", 20, 6), ("none", 20, 6)])
def test_spans(table, window, anchor, request):
    docs = request.getfixturevalue(table)
    got = span_graph.remove_repeats(docs, window, anchor).collect()
    assert len(got) == docs.count()
    want = brute_spans([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]]


def test_spans_of_few_words(spark):
    """A small vocabulary: windows repeat inside texts and branch everywhere."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in span_graph.remove_repeats(docs, 6, 2).collect()}
    assert got == brute_spans(rows, 6)


def brute_lines(rows, least):
    seen, out = {}, {}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    split = [(d, (t or "").split("\n"), t) for d, t in rows]
    worded = [(d, [(i, l) for i, l in enumerate(ls) if l.encode().split()], ls, t) for d, ls, t in split]
    for d, w, _, _ in worded:
        for at in range(len(w) - least + 1):
            seen.setdefault(tuple(l for _, l in w[at : at + least]), (d, at))
    for d, w, ls, t in worded:
        gone = set()
        for at in range(len(w) - least + 1):
            if seen[tuple(l for _, l in w[at : at + least])] != (d, at):
                gone.update(i for i, _ in w[at : at + least])
        out[d] = t if t is None else "\n".join(l for i, l in enumerate(ls) if i not in gone)
    return out


@pytest.mark.parametrize("table,least", [("odd", 1), ("odd", 2), ("odd", 3), ("odd", 5), ("repeated", 1), ("documents", 1), ("none", 1), ("repeated", 2), ("documents", 2), ("none", 2)])
def test_lines(table, least, request):
    docs = request.getfixturevalue(table)
    cleaned = line_suffixes.dedup_lines(docs, least)
    assert cleaned.columns == [*docs.columns, "_lines"]
    got = cleaned.collect()
    assert len(got) == docs.count()
    # a row without an id has the text of document 0, which it precedes
    want = brute_lines({(r["doc_id"], r["text"]) for r in docs.collect()}, least)
    for r in got:
        assert r["text"] == want[r["doc_id"]]


def test_a_line_between_differing_neighbours_goes(spark):
    line = " ".join(f"word{i}" for i in range(15))
    docs = spark.createDataFrame([(i, f"before {i}\n{line}\nafter {i}") for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_suffixes.dedup_lines(docs).collect()}
    assert got == {i: f"before {i}\n{line}\nafter {i}" if i == 0 else f"before {i}\nafter {i}" for i in range(5)}


def test_suffix_ranks_reach_the_longest_run(spark):
    body = "\n".join(f"line {i}" for i in range(20))
    docs = spark.createDataFrame([(1, body), (2, "x\n" + body)], "doc_id long, text string")
    levels = line_suffixes.suffix_ranks(line_suffixes.line_ids(docs, "doc_id", "text").cache())
    assert [depth for depth, _ in levels] == [1, 2, 4, 8, 16]
    assert [ranks.count() for _, ranks in levels] == [2 * (20 - d + 1) for d in (1, 2, 4, 8, 16)]


def test_kept_hash(spark, documents):
    from stratalens.llm import queries

    got = {r["doc_id"]: r for r in queries.op4_de_bruijn_spans(spark, "/root/testdata/sf0.001").collect()}
    want = brute_spans([(r["doc_id"], r["text"]) for r in documents.collect()], 20)
    assert {d: r["kept_sha256"] for d, r in got.items()} == {
        d: hashlib.sha256(w[2].encode()).hexdigest() for d, w in want.items()
    }
