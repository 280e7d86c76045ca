"""SentencePiece ids by merge rounds against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import piece_rounds, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOOL = piece_rounds.Encoder(MODEL)


@pytest.mark.parametrize("table", ["odd", "repeated", "none", "documents"])
def test_ids_and_texts_are_the_librarys(table, request):
    docs = request.getfixturevalue(table)
    got = piece_rounds.decode(piece_rounds.encode(docs, MODEL), MODEL).collect()
    key = lambda row: tuple(map(str, row))
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], np.array(ids, dtype="<u4").tobytes(), LIBRARY.decode(ids)))
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["text"]) for r in got), key=key) == sorted(want, key=key)


def test_query_digests(spark):
    rows = {r["doc_id"]: r for r in queries.op13_merge_rounds(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(texts)
    for r in texts:
        ids = LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabbeehnrst  ▁.\n\té日😀\0"), max_size=40), min_size=1, max_size=6))
def test_few_letters(texts):
    assert [x.tolist() for x in TOOL.encode(texts)] == LIBRARY.encode(texts)


def test_joined_pieces_without_blanks():
    rng = random.Random(3)
    parts = [LIBRARY.id_to_piece(i).replace("▁", "") for i in range(300, 32000)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(parts) for _ in range(5000)), "a" * 20001, "ab" * 9999, " " * 3000, "the" * 4000]
    assert [x.tolist() for x in TOOL.encode(texts)] == LIBRARY.encode(texts)


def test_rounds_merge_all_words_at_once():
    """Many words take as many rounds as the word that needs most; a merge that comes first holds the others back."""
    calls = []
    real = piece_rounds.merge_round

    def counted(pieces, symbol, merged, rank, word):
        calls.append(len(set(word.tolist())))
        return real(pieces, symbol, merged, rank, word)

    words = [f"▁{a}{b}ther{c}ing" for a in "abcdeth" for b in "rstaeo" for c in "abcd"]
    piece_rounds.merge_round = counted
    try:
        ids, count = piece_rounds.encode_words(TOOL.pieces, words)
    finally:
        piece_rounds.merge_round = real
    assert calls[0] == len(words) and len(calls) <= max(map(len, words))
    assert np.split(ids, np.cumsum(count)[:-1])[5].tolist() == LIBRARY.encode(words[5][1:])


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece_rounds, "KEPT_WORDS", 3)
    tool = piece_rounds.Encoder(MODEL)
    for text in ("one two three four five", "five six one", "", "two"):
        assert tool.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_chunks_hold_every_text_once():
    texts = ["x" * n for n in (0, piece_rounds.CHUNK_CHARS * 2, 5, 0, piece_rounds.CHUNK_CHARS, 1)]
    runs = list(piece_rounds.chunks(texts))
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(texts)))
    assert list(piece_rounds.chunks([])) == []
