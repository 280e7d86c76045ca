"""Ids that are null or shared by different texts, and columns named like those that operators use inside."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from stratalens.llm import hilbert_shards, ngram_trie, span_graph
from stratalens.llm.span_graph import WINDOW

INSIDE = (
    "host_rate bad_host _host _c _at _row _quality removed deepest _doc _twin _all _flags _lines _first _key _id _slot _kept "
    "shard slot copy keys bytes number block size due released n_words kept base_failed own doc row"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(5)]
    near = texts[0].split()
    near[50] = "other"
    page = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(8))
    bodies = [*texts, " ".join(near), texts[0], page, "first\n" + page, None, "", " ", texts[1] + "\n" + texts[2], "few words"]
    rows = [
        (None if i % 3 == 0 else i // 2, t, "en", ["a", None, "b"][i % 3], len(t or ""), *([i] * len(INSIDE)))
        for i, t in enumerate(bodies)
    ]
    rows.append(rows[3])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in INSIDE)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_as_they_came(spark, clashing, name, stage):
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns
    given = Counter(r["_row"] for r in clashing.collect())
    for r in out.collect():
        assert len({r[c] for c in INSIDE}) == 1
        given[r["_row"]] -= 1
    assert min(given.values()) >= 0
    if name == "mixing":
        assert not any(given.values())


def test_shards_keep_clashing_columns(clashing, spark, tmp_path):
    hilbert_shards.write_shards(clashing, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*clashing.columns, "_shard"} and back.count() == clashing.count()


def test_spans_of_shared_and_missing_ids(spark):
    """Different texts of one id are places of their own: each is judged by its own words."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    alone = [" ".join(word() for _ in range(n)) for n in (60, 61, 25, 120)]
    shared = " ".join(word() for _ in range(40))
    rows = [(9, alone[0]), (9, alone[1]), (None, alone[2]), (None, alone[3]), (None, shared), (9, shared + " " + word()), (1, "x " + shared)]
    got = span_graph.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = Counter(r["kept"] for r in got if r["n_removed"] == 0)
    assert all(kept[t] == 1 for t in (*alone, shared))
    cut = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got if r["n_removed"])
    assert cut == [(1, 41, 40), (9, 41, 40)] and len(got) == len(rows) and WINDOW == 20


def test_a_missing_file_of_the_trie_is_an_error(spark, documents, tmp_path):
    model = ngram_trie.train(documents.selectExpr("text as body"))
    with pytest.raises(FileNotFoundError):
        ngram_trie._mapped(str(tmp_path / "nowhere"), "words-0", ngram_trie._WORDS)
    with pytest.raises(FileNotFoundError):
        ngram_trie._write(str(tmp_path / "nowhere"), "words-0", {})
    assert ngram_trie._mapped(model.folder, "words-0", ngram_trie._WORDS) is not None
    ngram_trie._write(str(tmp_path), "empty", {})
    assert ngram_trie._mapped(str(tmp_path), "empty", ngram_trie._PAIRS) is None
