"""Merkle manifest of a dataset: one ternary tree a source, one over the sources, stored in blocks with van Emde Boas layout.

A tree is cut into aligned subtrees of ``height`` levels. Each is one row, whose nodes are laid out by splitting its levels in half:
first the upper half, then the lower subtrees one after the other, each laid out in the same way. The roots of the blocks are the
leaves of the next, smaller round of blocks, until one block is left. Where a node lies follows from its depth and number alone, for
building as well as for finding the siblings of a leaf.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .ranks import positions

ARITY = 3
EMPTY = b""


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` at ``depth`` (0: the root) lie in the layout of a tree of ``levels`` levels."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        under = ARITY ** (depth - top)
        at += size(top) + (index // under) * size(levels - top)
        index, depth, levels = index % under, depth - top, levels - top
    return at


def combine(children: list[bytes]) -> bytes:
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def _counts(n: int, height: int) -> list[int]:
    """Nodes at each depth, the root's first, of a block with ``n`` leaves."""
    return [-(-n // ARITY ** (height - d)) for d in range(height + 1)]


def lay_out(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a block in layout order, 32 bytes each; nodes that do not exist are zeros."""
    nodes = np.zeros((size(height + 1), 32), np.uint8)
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(leaves)))] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
        leaves = [combine(leaves[i : i + ARITY]) for i in range(0, len(leaves), ARITY)]
    return nodes.tobytes()


def siblings(nodes: bytes, n: int, height: int) -> list[bytes]:
    """For each leaf of a block its way up: for each level one byte for its place in the run, one for the number of others, and their digests."""
    ways = [b""] * n
    for depth, count in zip(range(height, 0, -1), _counts(n, height)[:0:-1]):
        at = (address(height + 1, depth, np.arange(count)) * 32).tolist()
        digests = [nodes[a : a + 32] for a in at]
        step = []
        for i in range(count):
            run = digests[i - i % ARITY : i - i % ARITY + ARITY]
            step.append(bytes([i % ARITY, len(run) - 1]) + b"".join(run[: i % ARITY] + run[i % ARITY + 1 :]))
        span = ARITY ** (height - depth)
        ways = [w + step[i // span] for i, w in enumerate(ways)]
    return ways


def follow(leaf: bytes, way: bytes) -> tuple[bytes, bytes]:
    """(root, proof): the root that a leaf gives with the siblings of its way, and the digest of these siblings."""
    proof, at = sha256(), 0
    while at < len(way):
        place, n = way[at], way[at + 1]
        others = [way[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        for o in others:
            proof.update(o.hex().encode())
        leaf = combine([*others[:place], leaf, *others[place:]])
        at += 2 + 32 * n
    return leaf, proof.digest()


class Forest(NamedTuple):
    """The blocks of the trees of all groups, one table a round: (``g``, ``block``, ``total`` leaves of the round, ``n`` of its own, ``height``, ``root``, ``top``, ``nodes``)."""

    rounds: list[DataFrame]

    def tops(self) -> DataFrame:
        """(g, root): one row a group."""
        found = [r.where("top").select("g", "root") for r in self.rounds]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out


_BLOCK = "g string, block long, total long, n int, height int, root binary, top boolean, nodes binary"
_BLOCK_ARROW = pa.schema([("g", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("n", pa.int32()), ("height", pa.int32()), ("root", pa.binary()), ("top", pa.bool_()), ("nodes", pa.binary())])


def _grown(height: int):
    def run(t: pa.Table) -> pa.Table:
        total, width = t["total"][0].as_py(), ARITY**height
        tall = height
        if total <= width:
            tall = next(h for h in range(height + 1) if ARITY**h >= total)
        order = np.argsort(t["pos"].to_numpy())
        digests = t["digest"].to_pylist()
        nodes = lay_out([digests[i] for i in order], tall)
        return pa.Table.from_pydict({"g": [t["g"][0].as_py()], "block": [t["block"][0].as_py()], "total": [total], "n": [len(order)], "height": [tall], "root": [nodes[:32]], "top": [total <= width], "nodes": [nodes]}, schema=_BLOCK_ARROW)

    return run


def grow(leaves: DataFrame, height: int) -> Forest:
    """``leaves(g, pos, digest, total)``, ``pos`` from 0 in each group of ``total`` leaves without gaps, to the blocks of their trees. A block is one group of at most 3 ** ``height`` rows."""
    rounds: list[DataFrame] = []
    while True:
        dealt = leaves.withColumn("block", F.floor(F.col("pos") / ARITY**height))
        rounds.append(materialise(dealt.groupBy("g", "block").applyInArrow(_grown(height), _BLOCK), "blocks"))
        leaves = rounds[-1].where("not top").select("g", F.col("block").alias("pos"), F.col("root").alias("digest"), F.ceil(F.col("total") / ARITY**height).alias("total"))
        if leaves.isEmpty():
            return Forest(rounds)


def ways(forest: Forest, above: DataFrame, height: int) -> DataFrame:
    """Blocks of the first round with the way from their root on: (``g``, ``block``, ``n``, ``height``, ``nodes``, and what ``above(g, way, ...)`` has).

    ``above`` says how each group's tree goes on. Ways are handed down from round to round, a row for each block.
    """
    more = [f for f in above.schema.fields if f.name not in ("g", "way")]
    schema = "g string, block long, way binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)

    def children(batches):
        for b in batches:
            names, rows = b.schema.names, b.to_pylist()
            out = [(r["g"], r["block"] * ARITY**height + i, w + r["way"], *[r[f.name] for f in more]) for r in rows for i, w in enumerate(siblings(r["nodes"], r["n"], r["height"]))]
            kinds = [pa.string(), pa.int64(), pa.binary(), *[b.schema.field(names.index(f.name)).type for f in more]]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["g", "block", "way", *[f.name for f in more]])

    handed = None
    for blocks in reversed(forest.rounds):
        own = blocks.where("top").select("g", "block").join(above, "g").select("g", "block", "way", *[f.name for f in more])
        handed = own if handed is None else own.union(handed)
        held = blocks.select("g", "block", "n", "height", "nodes").join(handed, ["g", "block"])
        if blocks is not forest.rounds[0]:
            handed = held.mapInArrow(children, schema)
    return held


def leaf(fields: list[Column]) -> Column:
    """sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value, as 32 bytes."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256))


def group_key(source: Column) -> Column:
    """A text that is never null and sorts as the source does, null first, bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


class Manifest(NamedTuple):
    leaves: DataFrame
    sources: Forest
    whole: Forest
    height: int


def build(docs: DataFrame, digest: Column, others: dict[str, Column] | None = None, id_col: str = "doc_id", source_col: str = "source", height: int = 5) -> Manifest:
    """The manifest of ``docs``: a leaf a row, in each source by id (null first) and then by digest; sources in bytewise order, null first.

    ``others`` are more columns to keep with the leaves, such as digests of a later state. Texts stay where they are: 32 bytes a row
    are ordered, by range, so that a source of any size spreads over tasks. Repeated rows are leaves of their own. An empty table
    gives an empty manifest, without a root.
    """
    kept = docs.select(group_key(F.col(f"`{source_col}`")).alias("g"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), *[c.alias(n) for n, c in (others or {}).items()])
    leaves = materialise(positions(materialise(kept, "leaves"), "g", ["id", "digest"]), "leaves")
    sources = grow(leaves.select("g", "pos", "digest", "total"), height)
    tops = sources.tops().select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("root").alias("digest"))
    whole = grow(positions(tops, "g", ["source"]).select("g", "pos", "digest", "total"), height)
    return Manifest(leaves, sources, whole, height)


_PROVEN = "id {id}, leaf binary, subroot binary, root binary, proof binary, folded binary"


def prove(manifest: Manifest, state: str | None = None) -> DataFrame:
    """One row a leaf: (``id``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded``), digests of 32 bytes.

    ``folded`` is the root that follows from the leaf's siblings and its digest, or where ``state`` is not null, that column's.
    """
    tops = manifest.sources.tops()
    placed = positions(tops.select(F.lit("").alias("one"), "g", "root"), "one", ["g"]).select("g", F.col("root").alias("subroot"), "pos")
    root = manifest.whole.tops().select("g", F.lit(EMPTY).alias("way"), "root")
    ends = ways(manifest.whole, root, manifest.height).mapInArrow(_ends(manifest.height), "pos long, way binary, root binary")
    above = materialise(placed.join(ends, "pos").select("g", "way", "subroot", "root"), "tops")
    blocks = ways(manifest.sources, above, manifest.height).select("g", "block", "n", "height", "nodes", "way", "subroot", "root")
    own = manifest.leaves.select("g", F.floor(F.col("pos") / ARITY**manifest.height).alias("block"), "pos", "id", "digest", F.col(state or "digest").alias("state"))
    schema = _PROVEN.format(id=manifest.leaves.schema["id"].dataType.simpleString())
    return own.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(_folded(manifest.height), schema)


def _ends(height: int):
    def run(batches):
        for b in batches:
            out = [(r["block"] * ARITY**height + i, w + r["way"], r["root"]) for r in b.to_pylist() for i, w in enumerate(siblings(r["nodes"], r["n"], r["height"]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["pos", "way", "root"])

    return run


def _folded(height: int):
    def run(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        paths = siblings(block["nodes"], block["n"], block["height"])
        folded, proofs = [], []
        for pos, own, state in zip(leaves["pos"].to_pylist(), leaves["digest"].to_pylist(), leaves["state"].to_pylist()):
            end, proof = follow(state or own, paths[pos % ARITY**height] + block["way"])
            folded.append(end)
            proofs.append(proof)
        n = leaves.num_rows
        return pa.table({"id": leaves["id"], "leaf": leaves["digest"], "subroot": pa.array([block["subroot"]] * n, pa.binary()), "root": pa.array([block["root"]] * n, pa.binary()), "proof": pa.array(proofs, pa.binary()), "folded": pa.array(folded, pa.binary())})

    return run


def digest(proven: DataFrame, id_col: str = "doc_id") -> DataFrame:
    text = lambda c: F.lower(F.hex(c))
    return proven.select(F.col("id").alias(id_col), *[text(c).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))], (F.col("folded") == F.col("root")).alias("verified"))
