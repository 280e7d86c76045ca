"""Language-model scores from an n-gram trie in Elias-Fano code, of two or three words.

Level 1 of the trie holds the training tokens by the hash of their word, with exact counts and the weight that a context
leaves to unseen successors. Level 2 holds each context's successors: a number is the context's 34-bit part of its hash,
then 30 bits for the successor relative to that context, so successors of a context lie together and the whole level is one
monotone sequence. Counts there are quantised to a byte. Level 3 holds the successors of each node of level 2, by the node's place in its file
and up to 40 bits of the word's hash; in its Elias-Fano code the high bits are the pointers from level 2: each node's children
in unary. Each level is cut into files of even size that tasks map into memory and search by successor; a task touches only the
pages it needs, and nothing is broadcast but file names and borders.

The probability of a token after a context is interpolated absolute discounting:

    p(w | v) = max(c(v w) - D, 0) / c(v) + D distinct(v) / c(v) p(w),    p(w) = (c(w) + 1) / (N + V + 1)

with D = n1 / (n1 + 2 n2) from the numbers of pairs met once and twice; after an unknown context it is p(w). The context of
a text's first word is the end of a text. With three words, from the second word of a text on,

    p(w | u v) = max(c(u v w) - E, 0) / c(u v) + E distinct(u v) / c(u v) p(w | v)

with E from the triples as D from the pairs; after an unknown pair it is p(w | v).

Training is a pass over the texts for each level. Tasks sum equal tokens and pairs before anything is shuffled. Pairs go to level 2 as
compressed sorted runs, by ranges of their number whose borders follow the counts of level 1, so a context that holds a
third of all text is spread over many files. The children of a file of level 2 are one file of level 3, or, where its pairs are
so frequent that there may be too many, several by ranges of the child's hash, so a hot pair is spread, too. The files lie in the folder of ``spark.checkpoint.dir``, which must be mounted
on all executors.

Defined results: a null or blank text has one token, its end; a null id counts as the empty text for the split; without
training texts N and V are 0 and every score is 0; repeated rows are scored, and learned from, each.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .common import shared_folder, store
from .shingles import mixed, word_hashes

_U = np.uint64
END = word_hashes([b""])[0]  # no word is empty
CONTEXT_BITS = 34
_REST = 64 - CONTEXT_BITS
CHILD_BITS = 40
PAIRS_PER_FILE = 2_000_000
WORDS_PER_FILE = 1 << 18
_TOKENS_AT_ONCE = 1 << 22
_EXACT = 32  # counts up to here are kept as they are


@dataclass(frozen=True)
class Model:
    folder: str
    tokens: int  # N
    types: int  # V
    discount: float
    word_files: int
    borders: tuple[int, ...]  # first number of each level-2 file but the first
    parts: tuple[int, ...] = ()  # number of level-3 files below each level-2 file; none if there are two levels
    child_discount: float = 0.0


def tokens_of(text: bytes | None) -> np.ndarray:
    return np.append(word_hashes((text or b"").lower().split()), END)  # lower() of bytes changes A-Z only


def pair_numbers(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Level-2 number of each token after the one before it; ``ends``: where each text's tokens end."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate([[0], ends[:-1]])] = END
    for at in range(0, len(out), 1 << 16):  # in place, so no more arrays of this size are held
        part = slice(at, at + (1 << 16))
        out[part] = pair_number(out[part], tokens[part])
    return out


def child_bits(pairs: int) -> int:
    """Bits that tell a word among the children of a node, in a file of ``pairs`` nodes."""
    return min(CHILD_BITS, 64 - pairs.bit_length())


def pair_number(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    rest = mixed(context * _U(0x9E3779B97F4A7C15) + word) >> _U(CONTEXT_BITS)
    return (context >> _U(_REST) << _U(_REST)) | rest


def quantise(counts: np.ndarray) -> np.ndarray:
    """A byte per count: itself up to 32, then in steps of an eighth of an octave."""
    steps = np.minimum(np.round(8 * np.log2(np.maximum(counts, _EXACT) / _EXACT)), 255 - _EXACT)
    return np.where(counts <= _EXACT, counts, _EXACT + steps).astype(np.uint8)


def count_of(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes <= _EXACT, codes, _EXACT * 2 ** ((codes - _EXACT) / 8))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    for value in batch.column("body").cast(pa.large_binary()):
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of many texts, and where each text ends."""
    held, size = [], 0
    for batch in batches:
        for text in _texts(batch):
            held.append(tokens_of(text))
            size += len(held[-1])
            if size >= _TOKENS_AT_ONCE:
                yield _joined(held)
                size = 0
    if held:
        yield _joined(held)


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The arrays as one, and where each ends; ``held`` is emptied, so that they do not stay beside it."""
    out = np.concatenate(held), np.cumsum([len(h) for h in held])
    held.clear()
    return out


def word_table(docs: DataFrame) -> DataFrame:
    """word (hash as a long), count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _chunks(batches):
            words, counts = np.unique(tokens, return_counts=True)
            for at in range(0, len(words), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[part].view(np.int64)), pa.array(counts[part])], names=["word", "count"]
                )

    return docs.mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def file_borders(words: DataFrame, tokens: int, files: int) -> tuple[int, ...]:
    """Borders that cut level 2 into ``files`` ranges of even weight: a context weighs its count, spread evenly over its
    range. About 16 points a file reach the driver."""
    if files <= 1:
        return ()
    share = F.col("count") * (16.0 * files / tokens)
    chance = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / float(1 << 20)
    points = (
        words.select("word", F.floor(share + chance).alias("k"))
        .where("k > 0")
        .select("word", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
        .collect()
    )
    numbers = sorted(
        ((p["word"] % (1 << 64)) >> _REST << _REST) + int((p["i"] + 0.5) / p["k"] * (1 << _REST)) for p in points
    )
    step = max(len(numbers) / files, 1)
    return tuple(sorted({numbers[int(i * step)] for i in range(1, files) if int(i * step) < len(numbers)}))


def _pair_runs(docs: DataFrame, borders: tuple[int, ...]) -> DataFrame:
    """file, keys, counts: sorted runs of level-2 numbers (as differences) and their counts, compressed."""
    edges = np.array(borders, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for tokens, ends in _chunks(batches):
            numbers, counts = np.unique(pair_numbers(tokens, ends), return_counts=True)
            cuts = np.concatenate([[0], np.searchsorted(numbers, edges), [len(numbers)]])
            for file in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[file], cuts[file + 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(file)], pa.int32()),
                        pa.array([press.compress(np.diff(numbers[part], prepend=_U(0)).tobytes())], pa.binary()),
                        pa.array([press.compress(counts[part].astype(np.uint32).tobytes())], pa.binary()),
                    ],
                    names=["file", "keys", "counts"],
                )

    return docs.mapInArrow(run, "file int, keys binary, counts binary")


def _unpacked(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_buffer()), dtype=kind)


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file, each at a multiple of 8 bytes; a task that is run again replaces it whole.

    The driver has made the folder; where it is not mounted, this is an error.
    """
    part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(part, "wb") as out:
        lengths = [a.nbytes for a in arrays.values()]
        out.write(np.array([len(arrays), *lengths], dtype=np.int64).tobytes())
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    os.replace(part, os.path.join(folder, name))


_CODE = [("head", np.int64), ("base", np.uint64), ("low", np.uint64), ("high", np.uint64), ("zeros", np.int64), ("skip", np.uint64)]
_WORDS = [*_CODE, ("count", np.int64), ("rest", np.uint16)]
_PAIRS = [*_CODE, ("count", np.uint8), ("many", np.int64), ("many_at", np.int64)]
_TRIPLES = [*_CODE, ("count", np.uint8)]


def _mapped(folder: str, name: str, kinds: list[tuple[str, type]]) -> dict[str, np.ndarray] | None:
    """The arrays of a file, None if it was written without any. A file that is not there is an error."""
    file = np.memmap(os.path.join(folder, name), dtype=np.uint8, mode="r")
    if not file[:8].view(np.int64)[0]:
        return None
    lengths = file[8 : 8 + 8 * len(kinds)].view(np.int64)
    out, at = {}, 8 + 8 * len(kinds)
    for (key, kind), size in zip(kinds, lengths.tolist()):
        out[key] = np.asarray(file[at : at + size]).view(kind)
        at += size + -size % 8
    return out


def _summed(keys: list[np.ndarray], counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of runs, and the sums of their packed counts."""
    keys, counts = np.concatenate(keys), np.concatenate([_unpacked(c, np.uint32) for c in counts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _build_pairs(runs: DataFrame, folder: str, files: int) -> DataFrame:
    """Write the ``files`` files of level 2; context, distinct (its number of successors), and n1, n2, tokens once per file."""

    def run(table: pa.Table) -> pa.Table:
        number, table = table["file"][0].as_py(), table.filter(pc.is_valid(table["keys"]))
        if not table.num_rows:
            _write(folder, f"pairs-{number}", {})
            return pa.table([pa.array([], pa.int64())] * 6, names=["context", "distinct", "n1", "n2", "file", "tokens"])
        numbers, sums = _summed(
            [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in table["keys"]], table["counts"]
        )
        many = np.flatnonzero(sums >= _EXACT)  # contexts of level 3 count as they are
        code = elias_fano.encode(numbers)
        _write(folder, f"pairs-{number}", code | {"count": quantise(sums), "many": sums[many], "many_at": many})
        contexts, distinct = np.unique(numbers >> _U(_REST), return_counts=True)
        once, twice = int((sums == 1).sum()), int((sums == 2).sum())
        zeros = np.zeros(len(contexts), dtype=np.int64)
        n1, n2, tokens = zeros.copy(), zeros.copy(), zeros.copy()
        n1[0], n2[0], tokens[0] = once, twice, sums.sum()
        return pa.table(
            [pa.array(c) for c in (contexts.astype(np.int64), distinct.astype(np.int64), n1, n2, zeros + number, tokens)],
            names=["context", "distinct", "n1", "n2", "file", "tokens"],
        )

    # A row for each file, so that also one without pairs is written.
    every = runs.sparkSession.range(files).select(F.col("id").cast("int").alias("file"), *(F.lit(None).cast("binary").alias(c) for c in ("keys", "counts")))
    return runs.unionByName(every).groupBy("file").applyInArrow(
        run, "context long, distinct long, n1 long, n2 long, file long, tokens long"
    )


def _triple_runs(docs: DataFrame, model: Model) -> DataFrame:
    """file, bits, keys, counts: runs of children by their node in level 2 and the first ``bits`` bits of their word."""
    first = np.concatenate([[0], np.cumsum(model.parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for tokens, ends in _chunks(batches):
            inner, later = _inner(ends), _later(ends)
            above, words = pair_numbers(tokens, ends)[inner], tokens[later]
            del tokens, inner, later
            for at in range(0, len(above), _TOKENS_AT_ONCE):  # a single text may be longer
                part = slice(at, at + _TOKENS_AT_ONCE)
                pairs, place, short, counts = _counted_children(above[part], words[part])
                for file, level, pair, index in _look_up(model, "pairs", _pair_files(model, pairs), pairs):
                    low, high = np.searchsorted(place, [pair[0], pair[-1] + 1])
                    bits = child_bits(int(level["head"][0]))
                    keys = index[place[low:high] - pair[0]].astype(np.uint64) << _U(bits) | short[low:high] >> _U(CHILD_BITS - bits)
                    part = _part(short[low:high], model.parts[file])
                    for p in range(model.parts[file]):
                        mine = slice(None) if model.parts[file] == 1 else part == p
                        if len(keys[mine]):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([int(first[file] + p)], pa.int32()),
                                    pa.array([bits], pa.int32()),
                                    pa.array([press.compress(_planes(np.diff(keys[mine], prepend=_U(0))))], pa.binary()),
                                    pa.array([press.compress(counts[low:high][mine].tobytes())], pa.binary()),
                                ],
                                names=["file", "bits", "keys", "counts"],
                            )

    return docs.mapInArrow(run, "file int, bits int, keys binary, counts binary")


def _counted_children(above: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs; of each distinct child in order: its pair's place among them, its word's bits, its count.

    Few arrays of the size of the input live at a time, as this is where a task holds most."""
    order = np.argsort(above)
    numbers = above[order]
    new = np.concatenate([[True], numbers[1:] != numbers[:-1]])
    pairs = numbers[new]
    del numbers
    triples = np.cumsum(new, dtype=np.uint64)
    triples -= _U(1)
    triples <<= _U(CHILD_BITS)
    words = words[order]
    del order
    words >>= _U(64 - CHILD_BITS)
    triples |= words
    del words
    triples.sort()
    first = np.flatnonzero(np.concatenate([[True], triples[1:] != triples[:-1]]))
    counts = np.diff(first, append=len(triples)).astype(np.uint32)
    triples = triples[first]
    return pairs, (triples >> _U(CHILD_BITS)).view(np.int64), triples & _U((1 << CHILD_BITS) - 1), counts


def _later(ends: np.ndarray) -> np.ndarray:
    """Of each token, whether it is not the first of its text."""
    out = np.ones(ends[-1], dtype=bool)
    out[np.concatenate([[0], ends[:-1]])] = False
    return out


def _inner(ends: np.ndarray) -> np.ndarray:
    """Of each token, whether it is not the last of its text."""
    out = np.ones(ends[-1], dtype=bool)
    out[ends - 1] = False
    return out


def _part(short: np.ndarray, parts: int) -> np.ndarray:
    """Range of the first CHILD_BITS bits of a word that it lies in, of ``parts`` even ranges."""
    return ((short >> _U(CHILD_BITS - 32)) * _U(parts) >> _U(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then all second bytes: bytes that are mostly zero lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _build_triples(runs: DataFrame, folder: str, files: int) -> DataFrame:
    """Write the ``files`` files of level 3; n1, n2 of each."""

    def run(table: pa.Table) -> pa.Table:
        number, table = table["file"][0].as_py(), table.filter(pc.is_valid(table["keys"]))
        if not table.num_rows:
            _write(folder, f"triples-{number}", {})
            return pa.table([pa.array([0], pa.int64())] * 2, names=["n1", "n2"])
        keys = (_unpacked(k, np.uint8).reshape(8, -1).T for k in table["keys"])
        keys = [np.cumsum(np.ascontiguousarray(k).view(np.uint64).ravel(), dtype=np.uint64) for k in keys]
        numbers, sums = _summed(keys, table["counts"])
        _write(folder, f"triples-{number}", elias_fano.encode(numbers, table["bits"][0].as_py()) | {"count": quantise(sums)})
        return pa.table([pa.array([int((sums == n).sum())], pa.int64()) for n in (1, 2)], names=["n1", "n2"])

    every = runs.sparkSession.range(files).select(
        F.col("id").cast("int").alias("file"),
        *(F.lit(None).cast(kind).alias(c) for c, kind in (("bits", "int"), ("keys", "binary"), ("counts", "binary"))),
    )
    return runs.unionByName(every).groupBy("file").applyInArrow(run, "n1 long, n2 long")


def _build_words(words: DataFrame, contexts: DataFrame, folder: str, bits: int, discount: float) -> DataFrame:
    """Write the files of level 1, cut by the first ``bits`` bits of the hash."""
    context = F.shiftrightunsigned("word", _REST)
    rows = words.withColumn("context", context).join(contexts, "context", "left").select(
        F.shiftrightunsigned("word", 64 - bits).cast("int").alias("file") if bits else F.lit(0).alias("file"),
        "word",
        "count",
        F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"),
    )

    def run(table: pa.Table) -> pa.Table:
        number, table = table["file"][0].as_py(), table.filter(pc.is_valid(table["word"]))
        if not table.num_rows:
            _write(folder, f"words-{number}", {})
            return pa.table([pa.array([number], pa.int32())], names=["file"])
        hashes = table["word"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        counts = table["count"].to_numpy()[order]
        rest = np.clip(discount * table["distinct"].to_numpy()[order] / counts, 1e-15, 1.0)
        _write(
            folder,
            f"words-{number}",
            elias_fano.encode(hashes[order]) | {"count": counts, "rest": np.round(-np.log10(rest) * 4096).astype(np.uint16)},
        )
        return pa.table([pa.array([number], pa.int32())], names=["file"])

    every = words.sparkSession.range(1 << bits).select(
        F.col("id").cast("int").alias("file"), *(F.lit(None).cast("long").alias(c) for c in ("word", "count", "distinct"))
    )
    return rows.unionByName(every).groupBy("file").applyInArrow(run, "file int")


def mounted(folder: str) -> str:
    """The local path of a folder that every executor mounts."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the trie is memory-mapped, so spark.checkpoint.dir must be a mounted folder, not {folder}")
    return url.path


def train(docs: DataFrame, order: int = 2) -> Model:
    """``docs`` has body. Writes the trie of ``order`` levels and returns what tasks need to find their way in it."""
    if order not in (2, 3):
        raise ValueError(f"a trie has 2 or 3 levels, not {order}")
    folder = shared_folder(docs.sparkSession)
    path = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    folder = mounted(folder)
    words = store(word_table(docs))
    total = words.agg(F.sum("count").alias("n"), F.count("*").alias("v")).first()
    tokens, types = int(total["n"] or 0), int(total["v"])
    files = tokens // PAIRS_PER_FILE + 1
    borders = file_borders(words, tokens, files)
    built = store(_build_pairs(_pair_runs(docs, borders), folder, files))
    discount = _discount(built)
    bits = max((types // WORDS_PER_FILE).bit_length(), 0)
    contexts = built.groupBy("context").agg(F.sum("distinct").alias("distinct"))
    store(_build_words(words, contexts, folder, bits, discount))
    model = Model(folder, tokens, types, discount, 1 << bits, borders)
    if order == 2:
        return model
    weights = {r["file"]: r["tokens"] for r in built.where("tokens > 0").select("file", "tokens").collect()}
    model = replace(model, parts=tuple(weights.get(f, 0) // (2 * PAIRS_PER_FILE) + 1 for f in range(files)))
    return replace(model, child_discount=_discount(store(_build_triples(_triple_runs(docs, model), folder, sum(model.parts)))))


def _discount(built: DataFrame) -> float:
    once = built.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    n1, n2 = int(once["n1"] or 0), int(once["n2"] or 0)
    return n1 / (n1 + 2 * n2) if n1 else 0.5


@lru_cache(maxsize=1 << 14)  # a chunk of tokens meets every file, so all stay open: some 8000 at 30 GB
def _open(folder: str, name: str) -> dict[str, np.ndarray] | None:
    return _mapped(folder, name, {"words": _WORDS, "pairs": _PAIRS, "triples": _TRIPLES}[name.split("-")[0]])


def _look_up(model: Model, name: str, file_of: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
    """For sorted queries, of each file met: (file, its arrays, queries that are in it, their index in the file)."""
    files, starts = np.unique(file_of, return_index=True)
    for file, low, high in zip(files, starts, [*starts[1:], len(queries)]):
        level = _open(model.folder, f"{name}-{int(file)}")
        if level is not None:
            index = elias_fano.find(level, queries[low:high])
            known = np.flatnonzero(index >= 0)
            if len(known):
                yield int(file), level, low + known, index[known]


def _pair_files(model: Model, pairs: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(model.borders, dtype=np.uint64), pairs, side="right")


def score_tokens(model: Model, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, log10 of the base probability and log10 of the model's probability of each token."""
    words, place = np.unique(tokens, return_inverse=True)
    counts = np.zeros(len(words), dtype=np.int64)
    rest = np.ones(len(words))
    bits = model.word_files.bit_length() - 1
    file_of = (words >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), dtype=np.int64)
    for _, level, at, index in _look_up(model, "words", file_of, words):
        counts[at] = level["count"][index]
        rest[at] = 10.0 ** (-level["rest"][index].astype(np.float64) / 4096)
    base = np.log10((counts + 1) / (model.tokens + model.types + 1))
    single = (counts + 1) / (model.tokens + model.types + 1)

    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[np.concatenate([[0], ends[:-1]])] = np.searchsorted(words, END)  # every text has its end, so it is there
    numbers = pair_numbers(tokens, ends)
    order = np.argsort(numbers)
    numbers = numbers[order]
    new = np.concatenate([[True], numbers[1:] != numbers[:-1]])
    pairs, run = numbers[new], np.cumsum(new) - 1
    seen = np.zeros(len(pairs))
    nodes = []  # of each file: the pairs in it and their places there
    for file, level, at, index in _look_up(model, "pairs", _pair_files(model, pairs), pairs):
        seen[at] = count_of(level["count"][index])
        nodes.append((file, level, at, index))
    met = np.empty(len(tokens))
    met[order] = seen[run]
    context = counts[before]
    direct = np.maximum(met - model.discount, 0) / np.maximum(context, 1)
    chance = np.where(context > 0, direct + rest[before] * single[place], single[place])
    if model.parts:
        above = np.flatnonzero(_inner(ends)[order])  # pairs that a word of their text follows
        child = order[above] + 1
        chance[child] = _with_children(model, nodes, run[above], tokens[child], chance[child])
    return counts[place], base[place], np.log10(np.minimum(chance, 1.0))


def _with_children(model: Model, nodes: list[tuple], above: np.ndarray, words: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probability of each word as a child of the pair ``above`` it, given that with a shorter context; by order of the pair."""
    short, out = words >> _U(64 - CHILD_BITS), shorter.copy()
    first_part = np.concatenate([[0], np.cumsum(model.parts)])
    for file, level, at, index in nodes:
        context = level["count"][index].astype(np.float64)
        many = np.flatnonzero(context >= _EXACT)
        context[many] = level["many"][np.searchsorted(level["many_at"], index[many])]
        low, high = np.searchsorted(above, [at[0], at[-1] + 1])
        place = np.full(at[-1] + 1 - at[0], -1, dtype=np.int64)
        place[at - at[0]] = np.arange(len(at))
        mine = place[above[low:high] - at[0]]
        known = np.flatnonzero(mine >= 0)
        mine, known = mine[known], known + low
        word = short[known]
        part = _part(word, model.parts[file])
        seen, distinct = np.zeros(len(known)), np.zeros(len(at))
        for p in range(model.parts[file]):
            children = _open(model.folder, f"triples-{int(first_part[file] + p)}")
            if children is None:
                continue
            first, end = elias_fano.spans(children, index.astype(np.uint64))
            distinct += end - first
            asked = slice(None) if model.parts[file] == 1 else np.flatnonzero(part == p)
            node, low_bits = mine[asked], int(children["head"][1])
            number = index[node].astype(np.uint64) << _U(low_bits) | word[asked] >> _U(CHILD_BITS - low_bits)
            found = elias_fano.search(children, first[node], end[node], number)
            seen[asked] = np.where(found >= 0, count_of(children["count"][found]), 0)
        weight = context[mine]
        direct = np.maximum(seen - model.child_discount, 0) / weight
        out[known] = direct + model.child_discount * distinct[mine] / weight * shorter[known]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` has doc, held_out and body: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = _texts(batch), 0
            while at < batch.num_rows:
                held, size, first = [], 0, at
                while at < batch.num_rows and size < _TOKENS_AT_ONCE // 4:
                    held.append(tokens_of(next(texts)))
                    size += len(held[-1])
                    at += 1
                ends = np.cumsum([len(h) for h in held])
                starts = np.concatenate([[0], ends[:-1]])
                counts, base, full = score_tokens(model, np.concatenate(held), ends)
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        part.column("held_out"),
                        pa.array(ends - starts),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(held), model.tokens, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(full, starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % folds == fold


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Learn from the documents not held out and score all, by ``order`` - 1 words of context."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("body")
    )
    return score(rows, train(rows.where("not held_out").select("body"), order))
