"""Documents that share most of their word shingles: MinHash LSH forest, then exact verification.

Texts of the same words are one class of copies, and only one of them goes on, under a number of its own. Every tree of the forest holds the
signatures as sequences of ``DEPTH`` values, a prefix trie. A match of full depth is only likely for very similar texts, so
the matched prefix is shortened level by level until a pair at the threshold meets in some tree with the target recall.
Texts under one node of that depth are candidates:

- in nodes of up to ``SMALL`` texts each pair is a row, kept if the signatures agree often enough, then verified exactly;
- texts of larger nodes, groups of near copies of any size, are numbered so that neighbours of the forest get near numbers,
  and cut into blocks. Pairs of blocks that share a node go to a task each, which verifies all their pairs exactly with
  matrix products and returns a count per text and a spanning forest of the links, never the pairs.

Links join texts into near-duplicate classes by large-star and small-star rounds.

Defined results: a text without words (null, empty, blank) is a class of its own without links; one of fewer words than a
shingle has one shingle, all its words; repeated rows are copies and each get a row; rows without an id and different texts
of one id link like others; a class is named by its smallest id, by null if it has none, so that texts of one id can give two
classes one name, which ``one_of_each`` still tells apart; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_sums, store, whole_row
from .shingles import mixed, packed_text, shingle_set, texts_of, unpacked

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.999
SMALL = 32
BLOCK = 512
# A pair at the threshold agrees in 0.8 of 128 values, give or take 0.035; 0.64 is 4.5 such deviations below.
SLACK = 0.16
_SEED = 20240229


def depth_for(threshold: float, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(shingles: list[np.ndarray], values: int) -> np.ndarray:
    """MinHash values, 32 bits, one row per set."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 2**63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(shingles), values), dtype=np.uint64)
    for i, hashes in enumerate(shingles):
        least = np.full(values, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 2048):
            np.minimum(least, (hashes[at : at + 2048, None] * factors).min(axis=0), out=least)
        out[i] = least
    return (out >> np.uint64(32)).astype(np.uint32)


def sign(docs: DataFrame, depth: int, trees: int, deepest: int, words: int) -> DataFrame:
    """All columns but body, copy (hash of the words), keys (of the node in each tree), bytes (low bits of the signature)."""
    kept = [c for c in docs.columns if c != "body"]
    made = {"copy": T.BinaryType(), "keys": T.ArrayType(T.LongType()), "bytes": T.BinaryType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.split() for t in texts_of(part.column("body"))]
                used = [i for i, t in enumerate(texts) if t]
                values = signatures([shingle_set(texts[i], words) for i in used], trees * deepest)
                keys = np.zeros((len(used), trees), dtype=np.uint64)
                prefix = values.reshape(len(used), trees, deepest)
                for level in range(depth):
                    keys = mixed(keys + prefix[:, :, level] + np.arange(trees, dtype=np.uint64) * np.uint64(1 << 40))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(pa.array(used, pa.int64())) for c in kept),
                        pa.array([hashlib.md5(b" ".join(texts[i])).digest() for i in used], pa.binary()),
                        pa.array([row.view(np.int64) for row in keys], pa.list_(pa.int64())),
                        pa.array([row.astype(np.uint8).tobytes() for row in values], pa.binary()),
                    ],
                    names=[*kept, *made],
                )

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, kind) for c, kind in made.items()])
    return docs.mapInArrow(run, schema)


def _sets(packed: Column, words: int) -> Column:
    """Sorted shingle hashes of packed texts, as bytes."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.split(), words).tobytes() for t in unpacked(column)], pa.binary())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(packed)


def _agreement(a: Column, b: Column) -> Column:
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(left.to_pylist()), dtype=np.uint8).reshape(len(left), -1)
        y = np.frombuffer(b"".join(right.to_pylist()), dtype=np.uint8).reshape(len(right), -1)
        return pa.array((x == y).mean(axis=1) if len(left) else [], pa.float64())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def _jaccard(a: Column, b: Column) -> Column:
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared / (len(x) + len(y) - shared))
        return pa.array(out, pa.float64())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def shared_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with all sets."""
    sizes = [len(s) for s in sets]
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(places, minlength=len(values)) > 1
    number = np.cumsum(common) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    owner, column = owner[common[places]], number[places[common[places]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((left, len(sets)), dtype=np.float32)
    step = 4096
    for first in range(0, int(common.sum()), step):
        low, high = np.searchsorted(column, [first, first + step])
        dense = np.zeros((len(sets), step), dtype=np.float32)
        dense[owner[low:high], column[low:high] - first] = 1
        total += dense[:left] @ dense.T
    return total


def _block_links(threshold: float):
    """For two blocks (or one with itself): links counted per text, and a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high = table["lo"][0].as_py(), table["hi"][0].as_py()
        blocks = table["block"].to_numpy()
        order = np.lexsort((table["doc"].to_numpy(), blocks))
        docs, blocks = table["doc"].to_numpy()[order], blocks[order]
        copies = table["copies"].to_numpy()[order]
        bodies = table["set"].to_pylist()
        sets = [np.frombuffer(bodies[i], dtype=np.uint64) for i in order]
        left = int((blocks == low).sum())
        sizes = np.array([len(s) for s in sets], dtype=np.float32)
        shared = shared_counts(sets, left)
        linked = shared >= threshold * (sizes[:left, None] + sizes[None, :] - shared) - 1e-3
        linked &= np.arange(len(sets))[None, :] != np.arange(left)[:, None]
        if low != high:
            linked[:, :left] = False
        links = np.zeros(len(sets), dtype=np.int64)
        links[:left] = linked @ copies
        if low != high:
            links[left:] = linked[:, left:].T @ copies[:left]
        root = np.arange(len(sets))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges: list[tuple[int, int]] = []
        for i in range(left):
            for j in np.flatnonzero(linked[i]):
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((int(docs[i]), int(docs[j])))
        rows = [(int(d), None, int(n)) for d, n in zip(docs, links) if n] + [(a, b, None) for a, b in edges]
        return pa.table(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=["a", "b", "links"]
        )

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node each is connected to. Large-star and small-star rounds; a hub is never one row."""

    def smallest(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return pairs.join(least, "a")

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    pairs = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(pairs)
    while True:
        large = smallest(both(pairs)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = smallest(large.where("a > b"))
        pairs = store(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = mark(pairs)
        if after == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id (smallest id of its near-duplicate class), n_links (documents of its similarity or more, copies
    among them), copy_id (smallest id of the same words): one row per row of ``docs``. For ``options`` see ``grouped``."""
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body"))
    return _per_row(bodies, *grouped(bodies, **options))


def grouped(
    bodies: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    trees: int = TREES,
    deepest: int = DEPTH,
    recall: float = RECALL,
    small: int = SMALL,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``bodies`` (doc, body, others) with words, signed; and for each copy its copy_id, class_id, n_links and root, which
    is the number of its class."""
    bodies = bodies.withColumn("own", F.unhex(F.md5(F.col("body").cast("binary"))))
    signed = store(sign(bodies, depth_for(threshold, trees, deepest, recall), trees, deepest, words))
    found = signed.groupBy("copy").agg(F.min("doc").alias("rep"), F.min("own").alias("own"), F.count("*").alias("copies"))
    # Numbers follow the ids, none last: the smallest number of a class has its smallest id.
    ordered = running_sums(found.withColumn("none", F.col("rep").isNull()), {"number": F.lit(1)}, ["none", "rep", "copy"])
    copies = store(ordered.drop("none"))
    # From here to the classes, doc is the number of a distinct text.
    numbers = copies.select("copy", F.col("number").alias("doc"), "copies")
    forest = store(
        signed.select("copy", "keys", "bytes").dropDuplicates(["copy"]).join(numbers, "copy").select("doc", "copies", "keys", "bytes")
    )

    postings = forest.select("doc", F.explode("keys").alias("node"))
    nodes = postings.groupBy("node").agg(F.count("*").alias("n"), F.min("doc").alias("hub")).where("n > 1")
    members = store(postings.join(nodes, "node"))

    # small nodes: pairs as rows
    few = members.where(F.col("n") <= small).select("node", "doc")
    pairs = (
        few.withColumnRenamed("doc", "a").join(few.withColumnRenamed("doc", "b"), "node").where("a < b").select("a", "b").distinct()
    )
    bytes_ = forest.select("doc", "bytes")
    likely = store(
        pairs.join(bytes_.toDF("a", "bytes_a"), "a")
        .join(bytes_.toDF("b", "bytes_b"), "b")
        .where(_agreement(F.col("bytes_a"), F.col("bytes_b")) >= threshold - SLACK)
        .select("a", "b")
    )

    # large nodes: blocks of texts, ordered by the smallest text they meet in a large node
    many = members.where(F.col("n") > small)
    placed = store(
        running_sums(many.groupBy("doc").agg(F.min("hub").alias("hub")), {"place": F.lit(1)}, ["hub", "doc"]).select(
            "doc", F.expr(f"place div {block}").alias("block")
        )
    )
    touched = many.select("node", "doc").join(placed, "doc").select("node", "block").distinct()
    meetings = store(
        touched.withColumnRenamed("block", "lo")
        .join(touched.withColumnRenamed("block", "hi"), "node")
        .where("lo <= hi")
        .select("lo", "hi")
        .distinct()
    )
    # what the blocks verify is left to them
    apart = (
        likely.join(placed.toDF("a", "block_a"), "a", "left")
        .join(placed.toDF("b", "block_b"), "b", "left")
        .withColumns({"lo": F.least("block_a", "block_b"), "hi": F.greatest("block_a", "block_b")})
        .withColumn("known", F.col("block_a").isNotNull() & F.col("block_b").isNotNull())
        .join(meetings.withColumn("met", F.lit(True)), ["lo", "hi"], "left")
        .where(~F.col("known") | F.col("met").isNull())
        .select("a", "b")
    )
    wanted = (
        likely.select(F.col("a").alias("doc"))
        .unionByName(likely.select(F.col("b").alias("doc")))
        .unionByName(placed.select("doc"))
        .distinct()
    )
    owners = copies.select(F.col("number").alias("doc"), "own").join(wanted, "doc")
    sets = store(
        bodies.select("own", packed_text(F.col("body")).alias("packed"))
        .dropDuplicates(["own"])  # in each task first, so a text of many rows is not one task's
        .join(owners.hint("merge"), "own")  # no size bound: never a broadcast
        .select("doc", _sets(F.col("packed"), words).alias("set"))
    )
    verified = store(
        apart.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .where(_jaccard(F.col("set_a"), F.col("set_b")) >= threshold)
        .select("a", "b")
    )
    weight = forest.select("doc", "copies")
    shipped = (
        meetings.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
        .join(placed, "block")
        .join(sets, "doc")
        .join(weight, "doc")
        .select("lo", "hi", "block", "doc", "copies", "set")
    )
    dense = store(shipped.groupBy("lo", "hi").applyInArrow(_block_links(threshold), "a long, b long, links long"))

    ends = verified.unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = (
        ends.join(weight.toDF("b", "links"), "b")
        .select("a", "links")
        .unionByName(dense.where("links is not null").select("a", "links"))
        .groupBy("a")
        .agg(F.sum("links").alias("links"))
    )
    roots = components(verified.unionByName(dense.where("b is not null").select("a", "b")))
    named = roots.join(copies.select(F.col("number").alias("root"), F.col("rep").alias("least")), "root")
    classes = store(
        copies.join(named.withColumnRenamed("node", "number"), "number", "left")
        .join(counted.withColumnRenamed("a", "number"), "number", "left")
        .select(
            "copy",
            F.col("rep").alias("copy_id"),
            F.coalesce("least", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "number").alias("root"),
        )
    )
    return signed, classes


def _wordless(bodies: DataFrame) -> DataFrame:
    return bodies.where(~F.coalesce(F.col("body").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))


def _per_row(bodies: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per document; those without words are not in ``signed``."""
    alone = _wordless(bodies).select(
        F.col("doc").alias("doc_id"),
        F.col("doc").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.col("doc").alias("copy_id"),
    )
    return (
        signed.select("doc", "copy")
        .join(classes, "copy")
        .select(F.col("doc").alias("doc_id"), "class_id", "n_links", "copy_id")
        .unionByName(alone)
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row, of the smallest id, of each near-duplicate class. A row without an id stays only if its class
    has none. Of equal rows without words one stays, if they have an id; without one each is a class of its own."""
    keyed = store(docs.select(whole_row(docs).alias("_kept"), F.monotonically_increasing_id().alias("_row")))
    row = F.col("_kept")
    bodies = keyed.select(row.getField(doc_id).cast("long").alias("doc"), row.getField(text).alias("body"), F.col("_row").alias("row"))
    signed, classes = grouped(bodies, **options)
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("best")
    worded = (
        signed.groupBy("copy").agg(best).join(classes, "copy").groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    )
    blank = _wordless(bodies)
    alone = blank.where("doc is not null").groupBy("doc", F.md5(F.col("body").cast("binary"))).agg(F.min("row").alias("row"))
    first = worded.unionByName(alone.select("row")).unionByName(blank.where("doc is null").select("row"))
    return keyed.join(first.withColumnRenamed("row", "_first"), F.col("_row") == F.col("_first"), "left_semi").select("_kept.*")
