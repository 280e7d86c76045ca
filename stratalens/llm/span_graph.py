"""Removal of long passages that occur earlier, by compaction of a De Bruijn graph of word k-mers.

Every window of ``WINDOW`` words is an edge of the graph, from the words but its last to the words but its first. Edges are
never shuffled one by one. Each has an anchor, the ``ANCHOR``-word part of least hash, and consecutive edges of a document
with the same anchor are one path; a path has about eight edges, and equal edges always lie at the same place about equal
anchors. So:

1. anchors are counted; a path whose anchor occurs once has no repeated edge and leaves;
2. paths left over are grouped by content. An anchor all of whose occurrences have the same content is a nonbranching
   stretch: the compacted path stands for its edges, and every occurrence but the first is a later copy as a whole;
3. where an anchor has several contents the graph branches (a passage begins or ends, or a text differs). The first
   occurrence of each content there goes back to its source coordinates, its edges are read from the text, and each is
   compared alone.

Edges that are later copies, as coordinates (document, start, number), are joined to the texts and the words they cover go.
Contents are compared by two 64-bit hashes, that of the anchor and that of the whole.

Defined results: a null or blank text has no words; a text of fewer words than a window keeps them all; repeated rows of one
id are one place, so they do not remove each other, and each gets its row; different texts of one id are places of their own,
in the order of a hash of the text; null is an id, the smallest; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .shingles import mixed, packed_text, texts_of, unpacked, windows, word_hashes

WINDOW = 20
ANCHOR = 6
_NO_ID = -(1 << 63)


def paths_of(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first edge and number of edges of each path of a text."""
    edges = windows(hashes, window)
    if not len(edges):
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    anchors = windows(hashes, anchor)
    at = np.lib.stride_tricks.sliding_window_view(anchors, window - anchor + 1).argmin(axis=1) + np.arange(len(edges))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    number = np.diff(np.append(first, len(edges)))
    # the first and the last edge overlap, so they fix all words of the path
    content = mixed(edges[first] * np.uint64(3) + mixed(edges[first + number - 1] + number.astype(np.uint64)))
    return anchors[at[first]], content, first, number


def _paths(docs: DataFrame, window: int, anchor: int, anchors_only: bool = False) -> DataFrame:
    """anchor, and unless ``anchors_only`` content, doc, own, start, n: a row per path of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [paths_of(word_hashes(t.split()), window, anchor) for t in texts_of(part.column("body"))]
                columns = [np.concatenate(c) for c in zip(*found)]
                names = ["anchor"]
                arrays = [pa.array(columns[0].view(np.int64))]
                if not anchors_only:
                    sizes = [len(f[0]) for f in found]
                    doc, own = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("doc", "own"))
                    arrays += [
                        pa.array(columns[1].view(np.int64)),
                        pa.array(doc),
                        pa.array(own),
                        pa.array(columns[2].astype(np.int32)),
                        pa.array(columns[3].astype(np.int32)),
                    ]
                    names += ["content", "doc", "own", "start", "n"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "anchor long" if anchors_only else "anchor long, content long, doc long, own long, start int, n int"
    return docs.mapInArrow(run, schema)


def _edges(packed: Column, spans: Column, window: int) -> Column:
    """Hashes of the edges that the paths of a text cover, with their starts."""

    def run(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for body, items in zip(unpacked(bodies), lists.to_pylist()):
            edges = windows(word_hashes(body.split()), window).view(np.int64)
            out.append(
                [
                    {"anchor": p["anchor"], "start": s, "edge": int(edges[s])}
                    for p in items
                    for s in range(p["start"], p["start"] + p["n"])
                ]
            )
        kind = pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("edge", pa.int64())])
        return pa.array(out, pa.list_(kind))

    run.__annotations__ = {"bodies": pa.Array, "lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<anchor:long,start:int,edge:long>>")(packed, spans)


def later_edges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, own, start, n: runs of edges whose words also start earlier. ``docs`` has doc and own (neither null), which tell
    different texts apart, and body."""
    place = F.struct("doc", "own", "start")
    # Counts are stored before they are joined: only a join of plain shuffles can split the rows of a hot anchor.
    counted = _paths(docs, window, anchor, anchors_only=True).groupBy("anchor").agg(F.count("*").alias("c"))
    repeated = store(counted.where("c > 1").select("anchor"))
    paths = store(_paths(docs, window, anchor).join(repeated, "anchor", "left_semi"))
    contents = store(
        paths.groupBy("anchor", "content").agg(
            F.min(place).alias("first"), F.min("n").alias("n"), F.count("*").alias("c")
        )
    )
    copies = paths.join(contents.where("c > 1").select("anchor", "content", "first"), ["anchor", "content"])
    whole = copies.where(place != F.col("first")).select("doc", "own", "start", "n")

    branching = store(contents.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
    ends = contents.join(branching, "anchor", "left_semi").select(
        "first.doc", "first.own", F.struct("anchor", "first.start", "n").alias("p")
    )
    lists = ends.groupBy("doc", "own").agg(F.collect_list("p").alias("paths"))
    packed = docs.select("doc", "own", packed_text(F.col("body")).alias("packed"))
    edges = store(
        packed.join(lists, ["doc", "own"])
        .select("doc", "own", F.explode(_edges(F.col("packed"), F.col("paths"), window)).alias("e"))
        .select("doc", "own", "e.*")
    )
    met = edges.groupBy("anchor", "edge").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    shared = store(met.where("c > 1").drop("c"))
    alone = edges.join(shared, ["anchor", "edge"]).where(place != F.col("first"))
    return whole.unionByName(alone.select("doc", "own", "start", F.lit(1).alias("n")))


def _cleaned(packed: Column, spans: Column, window: int) -> Column:
    def run(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        counts, removed, kept = [], [], []
        for body, items in zip(unpacked(bodies), lists):
            words = body.split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if items.is_valid:
                starts = items.values.field("start").to_numpy()
                ends = starts + items.values.field("n").to_numpy() + window - 1
                np.add.at(gone, starts, 1)
                np.add.at(gone, ends, -1)
            stays = np.cumsum(gone[:-1]) == 0
            counts.append(len(words))
            removed.append(len(words) - int(stays.sum()))
            kept.append(b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays)]).decode())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["n_words", "n_removed", "kept"],
        )

    run.__annotations__ = {"bodies": pa.Array, "lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "n_words long, n_removed long, kept string")(packed, spans)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank): one row per row of ``docs``."""
    bodies = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64(F.col(text)).alias("own"),
        F.col(text).alias("body"),
    )
    later = later_edges(bodies, window, anchor)
    spans = later.groupBy("doc", "own").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    packed = bodies.select("doc", "own", packed_text(F.col("body")).alias("packed"))
    cleaned = packed.join(spans, ["doc", "own"], "left").select("doc", _cleaned(F.col("packed"), F.col("spans"), window).alias("c"))
    return cleaned.select(F.nullif(F.col("doc"), F.lit(_NO_ID)).alias("doc_id"), "c.*")
