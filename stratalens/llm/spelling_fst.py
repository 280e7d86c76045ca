"""Spelling variants of a corpus's words by composing finite-state machines.

The words are counted in tasks and summed. Near words are the pairs that the composition A . E . A accepts, where A is the
minimised acceptor of the vocabulary and E passes every symbol through but one, which it inserts, deletes or replaces.

The composed machine is cut by its initial states. Take two near words, the shorter of length s, and k = s // 2: either
they agree in their first k letters, or the last s - k letters of both are the same. So a word of length L enters, for
s = L and s = L - 1, the partition of the state that its first k letters lead to, and, read backwards, that of its last s - k
letters. Each partition composes only from its own states on; what both would find counts in the forward one. A state whose
words are together longer than ``STATE_LETTERS`` is cut again: its successors become initial states, and edits right at
the state meet by what follows them. No task holds more than a state's words and some ``CHUNK_LETTERS`` letters.

In a task, many states are composed at once with numpy. Words sorted by state and letters give a trie; nodes with the same
future become one state of A, numbered so that a path's offsets add up to the word's row. From each state, every pair of
arcs (replaced), or an arc and the state itself (deleted or inserted), opens an intersection of two states' futures; equal
intersections are enumerated once and laid out for all paths that lead to the state.

Defined results: a null text has no words; a null id is empty in the checksum of the spelling slips; rows of one id or
repeated rows count each; an empty table gives no rows; ties between near words go to the smaller in code-point order;
only the id and the text are read. A word can be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, store

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form is a near word that occurs at least so many times as often.
FORM_FACTOR = 10
# One run in so many loses a letter.
SLIP = 31
# Letters of the words of one initial state; beyond it the state is cut.
STATE_LETTERS = 400_000
# Letters that are composed at once.
CHUNK_LETTERS = 200_000
# Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 200_000
# Letters of a partition, by which their number is chosen.
PARTITION_LETTERS = 4_000_000


def slipped(run: str, prefix: int) -> str:
    """The run, or in one of ``SLIP`` cases the run without one letter; ``prefix`` is the checksum of what stands before it."""
    code = zlib.crc32(run.encode(), prefix)
    if code % SLIP:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """word, n: runs of letters of all texts, with their slips, of at least ``least`` letters. Stored."""
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # a run of fewer letters gives no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                if not text:
                    continue
                # bytes.lower() changes A-Z alone.
                runs = Counter(letters.findall(text.encode().lower().decode()))
                number = batch.column(0)[row].as_py()
                prefix = zlib.crc32(f"{'' if number is None else number}:".encode())
                for word, n in runs.items():
                    word = slipped(word, prefix)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > COUNTED_WORDS:
                    yield batch_of()
                    counts.clear()
        if counts:
            yield batch_of()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _initial_states(words: DataFrame) -> DataFrame:
    """A row for each partition that a word (word, n) enters.

    key: the initial state; rest: the letters from there on, in the direction of reading; short: whether the word is of the
    partition's shorter length; cut: pairs that agree in so many first letters are counted elsewhere (0: in none).
    """
    length = F.length("word")

    def states(shorter: Column) -> list[Column]:
        k = F.floor(shorter / 2).cast("int")
        tail = shorter - k
        # Fixed width, so that states of words of like length stand together in a partition.
        size = F.lpad(shorter.cast("string"), 10, "0")
        short = length == shorter
        return [
            F.struct(
                F.concat(F.lit("f"), size, F.substr("word", F.lit(1), k)).alias("key"),
                F.substr("word", k + 1).alias("rest"),
                short.alias("short"),
                F.lit(0).alias("cut"),
            ),
            F.struct(
                F.concat(F.lit("r"), size, F.substr("word", length - tail + 1)).alias("key"),
                F.reverse(F.substr("word", F.lit(1), length - tail)).alias("rest"),
                short.alias("short"),
                k.alias("cut"),
            ),
        ]

    entered = F.explode(F.array(*states(length), *states(length - 1)))
    return words.select("word", "n", entered.alias("s")).select("s.*", F.lit(False).alias("doubled"), "word", "n")


def _cut_states(rows: DataFrame, letters: int) -> DataFrame:
    """Cut initial states of more than ``letters`` letters into their successors, until there is none."""
    settled = None
    while True:
        sizes = rows.groupBy("key").agg(F.sum(F.length("rest") + 1).alias("_size"))
        large = store(sizes.where(F.col("_size") > letters).select("key"))
        if large.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        kept = rows.join(large, "key", "left_anti")
        settled = kept if settled is None else settled.unionByName(kept)
        letter, tail = F.substr("rest", F.lit(1), F.lit(1)), F.substr("rest", F.lit(2))
        same = [F.col("short"), F.col("cut")]
        none = F.lit(False).alias("doubled")
        # Edits further on; a letter replaced or dropped right here; the word without that letter.
        later = F.struct(F.concat("key", letter).alias("key"), tail.alias("rest"), *same, none)
        here = F.struct(
            F.concat(F.lit("x"), "key", F.lit("|"), tail).alias("key"), letter.alias("rest"), *same,
            (letter == F.substr("rest", F.lit(2), F.lit(1))).alias("doubled"),
        )
        without = F.struct(F.concat(F.lit("x"), "key", F.lit("|"), "rest").alias("key"), F.lit("").alias("rest"), *same, none)
        cut = rows.join(large, "key", "left_semi").select(
            "word", "n", F.explode(F.when(F.col("rest") == "", F.array(without)).otherwise(F.array(later, here, without))).alias("s")
        )
        rows = store(cut.select("s.*", "word", "n"))


class Acceptor:
    """The minimised acceptor of rows sorted by (state, letters); ``codes`` holds letters from 1 on, 0 behind the end.

    ``node_class`` and ``node_row`` tell, for each node of the trie, its state and the first row below it. Of a state:
    ``final``, ``size`` (accepted words), ``lengths`` (a bit for each length), and its arcs by letter (``letter``, ``target``,
    ``offset`` in words) from ``first`` to ``last``.
    """

    def __init__(self, state: np.ndarray, codes: np.ndarray, length: np.ndarray) -> None:
        rows, width = codes.shape
        same_state = np.concatenate([[False], state[1:] == state[:-1]])
        # Letters that a row has in common with the one before it; -1 in another state.
        common = np.full(rows, -1, dtype=np.int64)
        if rows > 1:
            differs = codes[1:] != codes[:-1]
            shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else np.zeros(rows - 1, dtype=np.int64)
            common[1:] = np.where(same_state[1:], shared, -1)

        registry: dict[tuple, int] = {}
        finals: list[bool] = []
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self_class: list[np.ndarray] = []
        self_row: list[np.ndarray] = []
        below_parent = below_class = below_row = below_letter = np.zeros(0, dtype=np.int64)
        for depth in range(width, -1, -1):
            opens = (length >= depth) & (common < depth)
            row = np.flatnonzero(opens)
            number = np.cumsum(opens) - 1  # node of each row at this depth, where the row is long enough
            final = np.zeros(len(row), dtype=bool)
            ends = np.flatnonzero(length == depth)
            final[number[ends]] = True
            # Arcs of these nodes lead to the nodes below, which stand in order of their first rows.
            parent = number[below_row] if len(below_row) else below_parent
            first = np.searchsorted(parent, np.arange(len(row)))
            last = np.searchsorted(parent, np.arange(len(row)), side="right")
            signature = below_letter << 40 | below_class
            text = signature.tobytes()
            classes = np.empty(len(row), dtype=np.int64)
            for i, (a, b, f) in enumerate(zip(first.tolist(), last.tolist(), final.tolist())):
                key = (f, text[8 * a : 8 * b])
                found = registry.get(key)
                if found is None:
                    found = registry[key] = len(finals)
                    finals.append(f)
                    arcs.append((below_letter[a:b], below_class[a:b], below_row[a:b] - row[i]))
                classes[i] = found
            self_class.append(classes)
            self_row.append(row)
            below_class, below_row = classes, row
            below_letter = codes[row, depth - 1].astype(np.int64) if depth else below_letter
            below_parent = np.zeros(0, dtype=np.int64)

        self.node_class, self.node_row = np.concatenate(self_class), np.concatenate(self_row)
        self.final = np.array(finals, dtype=bool)
        counts = np.array([len(a) for a, _, _ in arcs], dtype=np.int64)
        self.last = np.cumsum(counts)
        self.first = self.last - counts
        self.letter, self.target, self.offset = (np.concatenate([x[i] for x in arcs]) for i in range(3))
        self.source = np.repeat(np.arange(len(finals)), counts)
        self.size = np.zeros(len(finals), dtype=np.int64)
        self.lengths = np.zeros(len(finals), dtype=np.uint64)
        top = np.uint64(1 << 63)
        for c, (f, a, b) in enumerate(zip(finals, self.first.tolist(), self.last.tolist())):
            # Targets are numbered before their sources.
            below = np.bitwise_or.reduce(self.lengths[self.target[a:b]]) if b > a else np.uint64(0)
            self.lengths[c] = (below << np.uint64(1)) | (below & top) | np.uint64(f)
            self.size[c] = int(f) + int(self.size[self.target[a:b]].sum())
        self.arc_key = self.source * (1 << 21) + self.letter

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The arc of each state by a letter, or -1."""
        wanted = state * (1 << 21) + letter
        at = np.minimum(np.searchsorted(self.arc_key, wanted), max(len(self.arc_key) - 1, 0))
        return np.where(self.arc_key[at] == wanted, at, -1) if len(self.arc_key) else np.full(len(state), -1)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs [first, last): the number of the run and the place, for each place of every run."""
    count = last - first
    run = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return run, np.arange(len(run)) - np.repeat(ends - count, count) + first[run]


def _both(a: Acceptor, run: np.ndarray, left: np.ndarray, right: np.ndarray, barred: np.ndarray | None = None):
    """One letter further in pairs of states: (run, arc of left, arc of right). ``barred``: a letter that a pair may not take."""
    at, arc = _spread(a.first[left], a.last[left])
    other = a.step(right[at], a.letter[arc])
    go = other >= 0
    if barred is not None:
        go &= a.letter[arc] != barred[at]
    return run[at[go]], arc[go], other[go], at[go]


def _intersections(a: Acceptor, left: np.ndarray, right: np.ndarray):
    """Words that both states of a pair accept, by number in each: (pair, i in left, i in right)."""
    pair, i, j = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
    found = []
    while len(pair):
        # All words of a state that meets itself; of others those that end here, then one letter on.
        same = left == right
        if same.any():
            run, at = _spread(np.zeros(int(same.sum()), dtype=np.int64), a.size[left[same]])
            found.append((pair[same][run], i[same][run] + at, j[same][run] + at))
        go = ~same & (a.lengths[left] & a.lengths[right] != 0)
        pair, left, right, i, j = pair[go], left[go], right[go], i[go], j[go]
        ends = a.final[left] & a.final[right]
        found.append((pair[ends], i[ends], j[ends]))
        pair, x, y, at = _both(a, pair, left, right)
        i, j = i[at] + a.offset[x], j[at] + a.offset[y]
        left, right = a.target[x], a.target[y]
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def accepted_pairs(state: np.ndarray, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each pair of one state whose letters are one edit apart, each pair once. Rows sorted by (state, letters)."""
    a = Acceptor(state, codes, length)
    arcs = np.arange(len(a.letter))
    # Replaced: two arcs of one state. An arc is paired with the later ones of its state.
    at, later = _spread(arcs + 1, a.last[a.source])
    source, left, right = a.source[at], a.target[at], a.target[later]
    i, j = a.offset[at], a.offset[later]
    # Deleted: an arc of a state against the state itself. The shorter word's next letter is another one, so that of all the
    # places in a run of equal letters only the last counts.
    ends = a.final[a.target] & a.final[a.source]
    whole = (a.source[ends], a.offset[ends], np.zeros(int(ends.sum()), dtype=np.int64))
    of, x, y, _ = _both(a, arcs, a.target, a.source, barred=a.letter)
    source = np.concatenate([source, a.source[of]])
    left, right = np.concatenate([left, a.target[x]]), np.concatenate([right, a.target[y]])
    i, j = np.concatenate([i, a.offset[of] + a.offset[x]]), np.concatenate([j, a.offset[y]])

    go = a.lengths[left] & a.lengths[right] != 0
    source, left, right, i, j = source[go], left[go], right[go], i[go], j[go]
    swap = left > right
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    states = len(a.final)
    distinct, which = np.unique(left * states + right, return_inverse=True)
    pair, p, q = _intersections(a, distinct // states, distinct % states)
    order = np.argsort(pair, kind="stable")
    pair, p, q = pair[order], p[order], q[order]
    run, at = _spread(np.searchsorted(pair, which), np.searchsorted(pair, which, side="right"))
    source = np.concatenate([source[run], whole[0]])
    i, j = np.concatenate([i[run] + p[at], whole[1]]), np.concatenate([j[run] + q[at], whole[2]])

    # Each path to a state lays its pairs out from the path's own first row.
    order = np.argsort(source, kind="stable")
    source, i, j = source[order], i[order], j[order]
    run, at = _spread(np.searchsorted(source, a.node_class), np.searchsorted(source, a.node_class, side="right"))
    row = a.node_row[run]
    return row + i[at], row + j[at]


def _letters(rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rest], dtype=np.int64)
    width = int(length.max(initial=0))
    flat = np.frombuffer("".join(rest).encode("utf-32-le"), dtype="<u4")
    codes = np.zeros((len(rest), width), dtype=np.uint32)
    row, column = _spread(np.zeros(len(rest), dtype=np.int64), length)
    codes[row, column] = flat + 1
    return codes, length


def _near_of_chunk(rows: pa.Table) -> pa.RecordBatch:
    """word, n_near, near_n, near of the words of whole initial states, sorted by (key, rest)."""
    key = rows["key"].to_numpy(zero_copy_only=False)
    state = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    rest = rows["rest"].to_pylist()
    codes, length = _letters(rest)
    u, v = accepted_pairs(state, codes, length)

    short, doubled = (rows[c].to_numpy(zero_copy_only=False) for c in ("short", "doubled"))
    word, cut, n = rows["word"].to_pylist(), rows["cut"].to_pylist(), rows["n"].to_numpy()
    heads: dict[str, int] = defaultdict(lambda: len(heads))
    head = np.array([heads[w[:c]] if c else -1 - i for i, (w, c) in enumerate(zip(word, cut))], dtype=np.int64)
    go = (short[u] | short[v]) & (head[u] != head[v])
    go &= ~((length[u] == 0) & doubled[v]) & ~((length[v] == 0) & doubled[u])
    u, v = np.concatenate([u[go], v[go]]), np.concatenate([v[go], u[go]])

    order = sorted(range(len(word)), key=lambda i: (-n[i], word[i]))
    place = np.empty(len(word), dtype=np.int64)
    place[order] = np.arange(len(word))
    best = np.full(len(word), len(word), dtype=np.int64)
    np.minimum.at(best, u, place[v])
    count = np.bincount(u, minlength=len(word))
    has = np.flatnonzero(count)
    near = [order[b] for b in best[has].tolist()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([word[i] for i in has.tolist()], pa.string()),
            pa.array(count[has], pa.int64()),
            pa.array(n[near] if near else [], pa.int64()),
            pa.array([word[i] for i in near], pa.string()),
        ],
        names=["word", "n_near", "near_n", "near"],
    )


def _whole_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cut a stream sorted by key into tables of whole keys, of some ``CHUNK_LETTERS`` letters (counted to the full width)."""
    held: list[pa.RecordBatch] = []
    rows = width = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rest = batch.column("key").to_numpy(zero_copy_only=False), batch.column("rest").to_pylist()
        borders = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        taken = 0
        for begin, end in zip([0, *borders], [*borders, len(rest)]):
            size = max(map(len, rest[begin:end])) + 1
            # At a border between keys: what is held goes on its own if the next key would make it too large.
            if (begin or key[0] != last) and rows and (rows + end - begin) * max(width, size) > CHUNK_LETTERS:
                held.append(batch.slice(taken, begin - taken))
                yield pa.Table.from_batches(held)
                held, rows, width, taken = [], 0, 0, begin
            rows, width = rows + end - begin, max(width, size)
        held.append(batch.slice(taken))
        last = key[-1]
    if rows:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame, state_letters: int = STATE_LETTERS) -> DataFrame:
    """word, n_near, near_n, near: for each word (word, n) with a near word, how many it has and the most frequent of them."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_states(batches):
            found = _near_of_chunk(table)
            if found.num_rows:
                yield found

    spark = words.sparkSession
    rows = _cut_states(_initial_states(words), state_letters)
    letters = words.agg(F.sum(2 * F.length("word"))).first()[0] or 0
    count = max(partitions(spark), letters // PARTITION_LETTERS + 1)
    dealt = rows.repartition(count, "key").sortWithinPartitions("key", "rest")
    parts = dealt.mapInArrow(compose, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))  # strings compare like code points
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. ``forms`` (word, form) is stored.

    Each form occurs at least ``FORM_FACTOR`` times as often as its word, so chains are short and have no cycle; a round
    doubles the steps taken.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = store(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return roots


def variants(words: DataFrame, factor: int = FORM_FACTOR, state_letters: int = STATE_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of a stored vocabulary (word, n)."""
    near = words.join(near_words(words, state_letters), "word", "left")
    has = F.col("near_n") >= factor * F.col("n")
    judged = store(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"),
        )
    )
    roots = _roots(judged.where(F.col("form").isNotNull()).select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs`` that occur at least ``LEAST_COUNT`` times."""
    return variants(store(count_words(docs, doc_id, text).where(F.col("n") >= LEAST_COUNT)))
