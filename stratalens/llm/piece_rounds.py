"""SentencePiece BPE by vectorised merge rounds: the library's ids, from numpy arrays over many words at once.

A text is cut where no piece of the model can reach across: before a run of blanks, and around characters that occur in
no longer piece. Each distinct word of a chunk is encoded once. The symbols of all words stand in one flat array. A round
finds each word's best pair (segmented minimum of ranks), merges all its occurrences from the left, and closes the gaps;
words without a pair leave the array; rounds end when it is empty.

The library merges one pair at a time: best score first, then leftmost. A round equals that sequence unless a merge
creates a pair as good as the round's or better, which would come next; in such a word only the merges up to that one
count, and the others wait. So the ids are the library's for every text.

Defined results: a null text is empty; an empty text has the begin and end ids alone and decodes to an empty text; repeated
rows and rows without an id are encoded each; an empty table gives no rows; other columns are not read. The model must be
of kind BPE, with byte fallback and no rewriting of characters; ``Pieces`` raises an error if the last two do not hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Characters encoded at once in a task; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 19
# Words, and ids of words, that a worker keeps between chunks.
KEPT_WORDS, KEPT_IDS = 200_000, 2_000_000
NO_PAIR = np.iinfo(np.int32).max
_CODES = 1 << 21  # more than there are code points


class Pieces:
    """Tables of a model: initial symbols, ranks of pairs, and ids that stand for bytes.

    A symbol is the id of its piece; a character that is no piece is the number of pieces plus its code point.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.size = model.get_piece_size()
        if model.normalize("a  Ａ b ") != f"{SPACE}a{SPACE}{SPACE}Ａ{SPACE}b{SPACE}":
            raise ValueError(f"{path}: the model rewrites characters or blanks")
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        ids = {model.id_to_piece(i): i for i in range(size) if not special[i]}
        scores = {i: model.get_score(i) for i in ids.values()}
        place = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        if not all(model.is_byte(int(i)) for i in self.bytes):
            raise ValueError(f"{path}: the model has no byte fallback")

        def symbol(part: str) -> int | None:
            return ids.get(part, size + ord(part) if len(part) == 1 else None)

        pairs: dict[int, int] = {}
        for piece, number in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * _CODES + right] = number
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.rank = np.array([place[scores[i]] for i in self.merged.tolist()], dtype=np.int32)
        self.letters = {c: i for c, i in ids.items() if len(c) == 1}

        joined = sorted({c for piece in ids if len(piece) > 1 for c in piece} - {SPACE})
        if any(SPACE in piece.lstrip(SPACE) for piece in ids):
            raise ValueError(f"{path}: a piece has a blank after another character")
        chars = "".join(map(re.escape, joined))
        words = f"{SPACE}*[{chars}]+|{SPACE}+|[^{chars}{SPACE}]" if chars else f"{SPACE}+|[^{SPACE}]"
        self.words = re.compile(words, re.DOTALL)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; ``NO_PAIR`` where the two form no piece."""
        wanted = left * _CODES + right
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), NO_PAIR, dtype=np.int32)
        return self.merged[at], np.where(self.keys[at] == wanted, self.rank[at], NO_PAIR)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(codes, return_inverse=True)
        table = [self.letters.get(chr(c), self.size + c) for c in distinct.tolist()]
        return np.array(table, dtype=np.int64)[where]


def _cumulative(counts: np.ndarray) -> np.ndarray:
    """Where each run of a flat array starts, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(counts)])


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs (start, count) of ``flat``, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - count), count) + np.arange(total)]


def merge_round(pieces: Pieces, symbol, merged, rank, word):
    """One round over flat arrays; every word must have a pair. Arrays: the symbols; piece and rank of each symbol's pair with
    the next one; the word of each symbol, ascending."""
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(word))))
    hit = np.flatnonzero(rank == best)
    # In a run of overlapping hits every second one is merged, from the left. A run ends with its word.
    first = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
    run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
    at = hit[(np.arange(len(hit)) - run) % 2 == 0]
    new = merged[at]

    # Pairs that a merge creates: with the symbol before it, itself merged already if it was a hit, and with the one after.
    n = len(symbol)
    follows = np.concatenate([[False], at[1:] == at[:-1] + 2])
    before = np.where(follows, np.concatenate([[0], new[:-1]]), symbol[np.maximum(at - 1, 0)])
    has_before = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
    has_after = (at + 2 < n) & (word[np.minimum(at + 2, n - 1)] == word[at])
    left_piece, left_rank = pieces.look_up(before, new)
    right_piece, right_rank = pieces.look_up(new, symbol[np.minimum(at + 2, n - 1)])
    left_rank = np.where(has_before, left_rank, NO_PAIR)
    right_rank = np.where(has_after, right_rank, NO_PAIR)

    early = (left_rank <= best[at]) | (right_rank <= best[at])
    if early.any():
        sums = np.cumsum(early) - early
        opens = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        base = np.maximum.accumulate(np.where(opens, sums, 0))
        done = sums == base  # no earlier merge of the word made a pair that comes first
        at, new, follows = at[done], new[done], follows[done]
        left_piece, left_rank, right_piece, right_rank = (x[done] for x in (left_piece, left_rank, right_piece, right_rank))
        has_before = has_before[done]

    symbol, merged, rank = symbol.copy(), merged.copy(), rank.copy()
    symbol[at], merged[at], rank[at] = new, right_piece, right_rank
    keep = np.ones(n, dtype=bool)
    keep[at + 1] = False
    # The symbol that now stands before a merge pairs with what was made: the earlier merge where it follows one.
    previous = np.where(follows, at - 2, at - 1)[has_before]
    merged[previous], rank[previous] = left_piece[has_before], left_rank[has_before]
    return symbol[keep], merged[keep], rank[keep], word[keep]


def encode_words(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and the number of ids of each word. No word may be empty."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], dtype=np.int64))
    symbol = pieces.symbols(codes)
    merged = np.zeros(len(symbol), dtype=np.int64)
    rank = np.full(len(symbol), NO_PAIR, dtype=np.int32)
    if len(symbol) > 1:
        merged[:-1], found = pieces.look_up(symbol[:-1], symbol[1:])
        rank[:-1] = np.where(word[:-1] == word[1:], found, NO_PAIR)
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        over = np.repeat(np.minimum.reduceat(rank, start) == NO_PAIR, np.diff(np.append(start, len(word))))
        if over.any():
            finished.append((word[over], symbol[over]))
            symbol, merged, rank, word = symbol[~over], merged[~over], rank[~over], word[~over]
        if len(symbol):
            symbol, merged, rank, word = merge_round(pieces, symbol, merged, rank, word)
    if not finished:
        return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
    word = np.concatenate([w for w, _ in finished])
    symbol = np.concatenate([s for _, s in finished])
    order = np.argsort(word, kind="stable")
    return _spell_out(pieces, symbol[order], word[order], len(words))


def _spell_out(pieces: Pieces, symbol: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters that are no piece by the ids of their UTF-8 bytes."""
    distinct, where = np.unique(symbol, return_inverse=True)
    spelled = [
        [s] if s < pieces.size else pieces.bytes[list(chr(s - pieces.size).encode())].tolist() for s in distinct.tolist()
    ]
    lengths = np.array([len(x) for x in spelled], dtype=np.int64)
    flat = np.array([i for x in spelled for i in x], dtype="<u4")
    count = lengths[where]
    ids = _gather(flat, _cumulative(lengths)[:-1][where], count)
    return ids, np.bincount(word, weights=count, minlength=words).astype(np.int64)


class Encoder:
    """Ids of whole texts. Words met before are taken from a bounded table."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS or len(self.flat) > KEPT_IDS:
            self.forget()
        split = [self.pieces.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.number))
        if fresh:
            ids, count = encode_words(self.pieces, fresh)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])
        start = _cumulative(self.count)[:-1]
        result = []
        for words in split:
            word = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
            result.append(_gather(self.flat, start[word], self.count[word]))
        return result


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(path)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of together some ``CHUNK_CHARS`` characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > CHUNK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the ids of each text with begin and end id, as little-endian unsigned 32-bit integers.

    ``model`` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (tool.pieces.model.bos_id(), tool.pieces.model.eos_id()))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small steps bound what is held at once
                piece = batch.slice(at, 256)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for a, b in chunks(texts):
                    ids = [begin + x.tobytes() + end for x in tool.encode(texts[a:b])]
                    yield pa.RecordBatch.from_arrays([piece.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text: the text that the library's ``decode`` gives for the ids of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(model).pieces.model
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                texts = [library.decode(np.frombuffer(b, dtype="<u4").tolist()) for b in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
