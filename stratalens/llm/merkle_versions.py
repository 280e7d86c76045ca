"""Merkle manifest of a dataset as a persistent tree: each changed leaf is a version of its own.

Rows become leaves, the leaves of a group stand in the order of their ids, and every two neighbours become a node, until one
node, the group's subroot, is left; the subroots become the root in the same way. A tree is cut into aligned blocks of
``2 ** BLOCK_BITS`` leaves, whose tops are the leaves of the tree above, which is cut again. So a task holds one block, never
a group. First the tops climb to the root; then the way from the root comes down, a row for each block.

Inside a block the tree is persistent: a changed leaf copies its ancestors and shares every other node with the version it
comes from. Its version goes on above the block by the same copying along the block's way to the root, in the same task;
no two versions meet.

Defined results: nulls are a field value of their own; groups are ordered with null first, then by bytes; rows without an
id stand first and never count as changed; rows of one id are ordered by leaf, and repeated rows are a leaf each; an empty
table gives no rows; columns that are not fields are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sums, store

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A step from a node to its parent: the side of the other node and its digest, or nothing where the node stands alone.
LEFT, RIGHT, ALONE = "<", ">", ""
_STEPS = "array<string>"
_TOP = "tree string, pos long, digest string"
_WAY = f"tree string, pos long, steps {_STEPS}, root string"


def field(value: Column) -> Column:
    """A value with the length of its UTF-8 form before it; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def node(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def step_up(digest: str, step: str) -> str:
    """Digest of the parent of a node."""
    side, other = step[:1], step[1:]
    return node(other + digest if side == LEFT else digest + other)


class BlockTree:
    """All versions of one block. Nodes are numbered and never changed; a version is the number of its top node."""

    def __init__(self, leaves: list[str], height: int | None = None) -> None:
        """``height``: levels above the leaves; by default until one node is left."""
        self.digest: list[str] = []
        self.children: list[tuple[int, int]] = []
        level = [self._add(d) for d in leaves]
        self.height = 0
        while len(level) > 1 if height is None else self.height < height:
            level = [self._join(level[i], level[i + 1] if i + 1 < len(level) else -1) for i in range(0, len(level), 2)]
            self.height += 1
        self.top = level[0]

    def _add(self, digest: str, left: int = -1, right: int = -1) -> int:
        self.digest.append(digest)
        self.children.append((left, right))
        return len(self.digest) - 1

    def _join(self, left: int, right: int) -> int:
        return self._add(node(self.digest[left] + (self.digest[right] if right >= 0 else "")), left, right)

    def way(self, top: int, index: int) -> list[tuple[int, int]]:
        """From a leaf up to ``top``: for each level the node number of the other child (-1 if none) and the leaf's bit."""
        found, at = [], top
        for level in reversed(range(self.height)):
            bit = index >> level & 1
            pair = self.children[at]
            at = pair[bit]
            found.append((pair[1 - bit], bit))
        return found[::-1]

    def steps(self, index: int) -> list[str]:
        return [
            ALONE if other < 0 else (LEFT if bit else RIGHT) + self.digest[other] for other, bit in self.way(self.top, index)
        ]

    def change(self, top: int, index: int, digest: str) -> tuple[int, list[int]]:
        """A new version of ``top`` with another leaf: its top, and the nodes copied for it from the leaf upwards."""
        at = self._add(digest)
        copied = [at]
        for other, bit in self.way(top, index):
            at = self._join(other, at) if bit else self._join(at, other)
            copied.append(at)
        return at, copied


def _height(block: int, rows: int, bits: int) -> int | None:
    """A block that is short and first is its whole tree and ends with one node; any other reaches the tree above."""
    return None if block == 0 and rows < 1 << bits else bits


def _block(nodes: DataFrame, bits: int) -> Column:
    return F.shiftright(nodes["pos"], bits)


def block_tops(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """tree, pos, digest: the top of each block of ``nodes`` (tree, pos, digest); pos is the block's number."""

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = table["pos"][0].as_py() >> bits
        tree = BlockTree(table["digest"].to_pylist(), _height(block, table.num_rows, bits))
        return pa.table({"tree": table["tree"].slice(0, 1), "pos": [block], "digest": [tree.digest[tree.top]]})

    chosen = nodes.select("tree", "pos", "digest")
    return chosen.groupBy("tree", _block(chosen, bits)).applyInArrow(top, _TOP)


def climb(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """tree, pos, steps, root: the way of each node to the root of its tree. ``nodes`` must be stored."""
    if nodes.where("pos > 0").isEmpty():
        return nodes.select("tree", "pos", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("root"))
    above = climb(store(block_tops(nodes, bits)), bits)

    def ways(table: pa.Table, way: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = table["pos"][0].as_py() >> bits
        tree = BlockTree(table["digest"].to_pylist(), _height(block, table.num_rows, bits))
        rest = way["steps"][0].as_py()
        steps = [tree.steps(i) + rest for i in range(table.num_rows)]
        root = way["root"][0].as_py()
        return pa.table(
            {"tree": table["tree"], "pos": table["pos"], "steps": pa.array(steps, pa.list_(pa.string())), "root": [root] * len(steps)}
        )

    left = nodes.select("tree", "pos", "digest")
    grouped = left.groupBy("tree", _block(left, bits)).cogroup(above.groupBy("tree", "pos"))
    return store(grouped.applyInArrow(ways, _WAY))


def _leaves(docs: DataFrame, fields: tuple[str, ...], group: str, doc_id: str, changed: dict[str, Column], where: Column) -> DataFrame:
    """tree, id, name, digest, changed: the leaf of each row, and the leaf it has where it is changed (else null)."""
    before = leaf([docs[c] for c in fields])
    after = leaf([changed.get(c, docs[c]) for c in fields])
    name = docs[group].cast("string")
    return docs.select(
        F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name)).alias("tree"),  # "-" stands before "="
        docs[doc_id].cast("long").alias("id"),
        name.alias("name"),
        before.alias("digest"),
        F.when(F.coalesce(where, F.lit(False)), after).alias("changed"),
    )


def manifest(
    docs: DataFrame,
    changed: dict[str, Column],
    where: Column,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    doc_id: str = "doc_id",
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Row by row the leaf, its proof and the root it leads to once the row is changed.

    ``where`` says which rows are changed, ``changed`` gives the new values of their fields. Columns: doc_id, ``group``'s
    value as ``name``, leaf, subroot, root, ``steps`` from the leaf to the root (side and digest of the other node, or empty),
    ``copied`` (digests of the nodes that the row's version does not share, from leaf to root; empty where the row is not
    changed), folded_root, verified.
    """
    leaves = store(running_sums(_leaves(docs, fields, group, doc_id, changed, where), {"pos": F.lit(1)}, ["id", "digest"], ["tree"]))
    blocks = climb(store(block_tops(leaves, bits)), bits)
    subroots = blocks.where("pos = 0").select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("digest"))
    subroots = store(running_sums(subroots, {"pos": F.lit(1)}, ["name"]))
    ways = climb(subroots.drop("name"), bits).select(F.col("pos").alias("_pos"), F.col("steps").alias("_steps"), F.col("root").alias("top"))
    ends = ways.join(subroots.select("name", "pos"), F.col("_pos") == F.col("pos")).select("name", "_steps", "top")
    blocks = blocks.join(ends, F.col("tree") == F.col("name")).select("tree", "pos", "steps", "_steps", "root", "top")

    def versions(table: pa.Table, way: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = table["pos"][0].as_py() >> bits
        leaf_digests, new = table["digest"].to_pylist(), table["changed"].to_pylist()
        tree = BlockTree(leaf_digests, _height(block, len(new), bits))
        above = way["steps"][0].as_py() + way["_steps"][0].as_py()
        subroot, root = way["root"][0].as_py(), way["top"][0].as_py()
        steps, copies, folded = [], [], []
        for i, digest in enumerate(new):
            steps.append(tree.steps(i) + above)
            copied: list[str] = []
            if digest is None:
                at = leaf_digests[i]
                for step in steps[-1]:
                    at = step_up(at, step)
            else:
                top, numbers = tree.change(tree.top, i, digest)
                copied = [tree.digest[n] for n in numbers]
                at = tree.digest[top]
                for step in above:
                    at = step_up(at, step)
                    copied.append(at)
            copies.append(copied)
            folded.append(at)
        listed = pa.list_(pa.string())
        return pa.table(
            {
                "doc_id": table["id"],
                "name": table["name"],
                "leaf": table["digest"],
                "subroot": [subroot] * len(new),
                "root": [root] * len(new),
                "steps": pa.array(steps, listed),
                "copied": pa.array(copies, listed),
                "folded_root": folded,
                "verified": [at == root for at in folded],
            }
        )

    grouped = leaves.groupBy("tree", _block(leaves, bits)).cogroup(blocks.groupBy("tree", "pos"))
    return grouped.applyInArrow(
        versions,
        f"doc_id long, name string, leaf string, subroot string, root string, steps {_STEPS}, copied {_STEPS}, "
        "folded_root string, verified boolean",
    )


def tampered(doc_id: Column, every: int = 7) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % every == 0


def proof(steps: Column) -> Column:
    """Digest of the other nodes on the way, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.substr(s, F.lit(2))), "").cast("binary"), 256)
