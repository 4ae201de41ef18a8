"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are dealt into shards of bounded size by label and hash. Each shard builds a layered graph; every vector queries every
shard of its label by beam search, in blocks of queries that advance together in numpy. An audit compares a sample of each
shard with exact search and widens the beam until it passes. Found pairs are verified in double precision; each task returns
link counts and a spanning forest of its links, and the forests are united by distributed components.

A task holds one graph and lets the queries stream by, sorted behind it, so a label of any size needs the memory of a shard. A
graph travels once for ``block_size`` queries.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, materialise, release, whole_id
from .components import components

#: Links of a node in the graph of a layer, and how many times fewer nodes the next layer has.
LINKS, RATIO = 16, 16


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int, at_layer: int = 0, known: int | None = None, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``width`` best nodes found for each query, best first; -1 where there are fewer.

    Search starts at node 0 of the top layer and keeps a narrow beam down to ``at_layer``, where the beam is ``width``.
    ``known`` limits the nodes of that layer to the first so many, while it is being built.
    """
    ids = np.zeros((len(q), 1), np.int64)
    sims = (q @ x[0])[:, None]
    for layer in range(len(layers) - 1, at_layer - 1, -1):
        links = layers[layer]
        n = known if layer == at_layer and known is not None else len(links)
        keep = min(width if layer == at_layer else 4, n)
        if (ids >= n).any():  # the layer is being built and lacks nodes of the one above
            ids, sims = np.zeros((len(q), 1), np.int64), (q @ x[0])[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last column stands for no node
        seen[:, n] = True
        np.put_along_axis(seen, np.where(ids < 0, n, ids), True, 1)
        done = ids < 0
        while True:
            open_sims = np.where(done, -np.inf, sims)
            take = min(step, open_sims.shape[1])
            pick = np.argpartition(-open_sims, take - 1, axis=1)[:, :take]
            live = np.take_along_axis(open_sims, pick, 1) > -np.inf
            alive = live.any(1)
            if not alive.any():
                break
            a = np.flatnonzero(alive)
            done[a[:, None], pick[a]] = True
            nodes = np.where(live[a], ids[a[:, None], pick[a]], -1)
            fresh = np.where((nodes >= 0)[:, :, None], links[nodes], n).reshape(len(a), -1)
            fresh = np.where((fresh < 0) | (fresh >= n), n, fresh)
            fresh.sort(1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh = np.where(seen[a[:, None], fresh], n, fresh)
            seen[a[:, None], fresh] = True
            used = (fresh < n).any(0)
            fresh = fresh[:, used]
            got = np.full(fresh.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh < n)
            got[r, c] = np.einsum("ij,ij->i", x[fresh[r, c]], q[a[r]])
            if ids.shape[1] < keep + fresh.shape[1]:
                more = keep + fresh.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, more)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, more)), constant_values=True)
            all_ids = np.concatenate([ids[a], np.where(fresh < n, fresh, -1)], 1)
            all_sims = np.concatenate([sims[a], got], 1)
            all_done = np.concatenate([done[a], fresh >= n], 1)
            top = np.argpartition(-all_sims, min(keep, all_sims.shape[1]) - 1, axis=1)[:, :keep]
            ids, sims, done = ids[:, :keep].copy(), sims[:, :keep].copy(), done[:, :keep].copy()
            if ids.shape[1] < keep:
                pad = keep - ids.shape[1]
                ids, sims, done = (np.pad(z, ((0, 0), (0, pad)), constant_values=v) for z, v in ((ids, -1), (sims, -np.inf), (done, True)))
            ids[a], sims[a], done[a] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours, nearest first, leaving out those nearer to a chosen one than to the node; then the nearest of the rest."""
    between = x[ids] @ x[ids].T
    chosen: list[int] = []
    for j in range(len(ids)):
        if all(between[j, c] < sims[j] for c in chosen):
            chosen.append(j)
            if len(chosen) == most:
                break
    chosen += [j for j in range(len(ids)) if j not in set(chosen)][: max(0, most // 2 - len(chosen))]
    return ids[chosen]


def build(x: np.ndarray, width: int = 32, batch: int = 512) -> list[np.ndarray]:
    """Layers of links, the widest first, for unit vectors in random order; layer l holds the first n / RATIO^l nodes."""
    sizes = [len(x)]
    while sizes[-1] > RATIO * 4:
        sizes.append(sizes[-1] // RATIO)
    layers: list[np.ndarray] = [None] * len(sizes)
    for layer in range(len(sizes) - 1, -1, -1):
        n = sizes[layer]
        links = np.full((n, 2 * LINKS), -1, np.int64)
        layers[layer] = links
        at = 0
        while at < n:
            end = min(n, at + max(32, min(batch, at)))
            own = x[at:end]
            inner = own @ own.T
            inner[np.triu_indices(len(own))] = -np.inf  # only nodes that came before
            near = np.argpartition(-inner, min(LINKS, len(own)) - 1, axis=1)[:, :LINKS]
            cand, sims = at + near, np.take_along_axis(inner, near, 1)
            if at:
                found, fs = beam_search(x, layers[layer:], own, width, 0, at)
                cand, sims = np.concatenate([cand, found], 1), np.concatenate([sims, np.where(found < 0, -np.inf, fs)], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            back: dict[int, list[int]] = {}
            for i in range(len(own)):
                keep = order[i][sims[i][order[i]] > -np.inf][: 2 * LINKS]
                if not len(keep):
                    continue
                near_ids = _spread(x, cand[i][keep], sims[i][keep], LINKS)
                links[at + i, : len(near_ids)] = near_ids
                for j in near_ids.tolist():
                    back.setdefault(j, []).append(at + i)
            for j, new in back.items():
                had = links[j][links[j] >= 0]
                both = np.concatenate([had, new])
                if len(both) > 2 * LINKS:
                    s = x[both] @ x[j]
                    o = np.argsort(-s, kind="stable")
                    both = _spread(x, both[o], s[o], 2 * LINKS)
                links[j] = -1
                links[j, : len(both)] = both
            at = end
    return layers


def range_search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, least: float, width: int, block: int = 512):
    """(query, node) pairs of similarity ``least`` or more. A beam that is full of such nodes may miss some: those queries scan the shard."""
    qs, ns = [], []
    for at in range(0, len(q), block):
        part = q[at : at + block]
        ids, sims = beam_search(x, layers, part, width)
        hit = (sims >= least) & (ids >= 0)
        full = hit.sum(1) * 2 >= ids.shape[1]
        hit[full] = False
        r, c = np.nonzero(hit)
        qs.append(at + r)
        ns.append(ids[r, c])
        rest = np.flatnonzero(full)
        if len(rest):
            r, c = np.nonzero(part[rest] @ x.T >= least)
            qs.append(at + rest[r])
            ns.append(c)
    return np.concatenate(qs), np.concatenate(ns)


def audited_width(x: np.ndarray, layers: list[np.ndarray], least: float, recall: float, width: int = 32, sample: int = 256) -> int:
    """The beam width at which a sample of the shard finds ``recall`` of its neighbours in range and of its nearest four; doubled until it does."""
    pick = np.unique(np.linspace(0, len(x) - 1, min(sample, len(x))).astype(np.int64))
    exact = x[pick] @ x.T
    near = np.argpartition(-exact, min(4, len(x)) - 1, axis=1)[:, :4]
    wanted = {(i, int(j)) for i in range(len(pick)) for j in near[i]} | {(int(i), int(j)) for i, j in zip(*np.nonzero(exact >= least))}
    while width < len(x):
        ids, _ = beam_search(x, layers, x[pick], width)
        q, n = range_search(x, layers, x[pick], least, width)
        got = {(i, int(j)) for i in range(len(pick)) for j in ids[i] if j >= 0} | {*zip(q.tolist(), n.tolist())}
        if len(wanted & got) >= recall * len(wanted):
            break
        width *= 2
    return width


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges, each node to the least of its tree."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


GROUP = ["lab", "dim", "shard"]
GRAPH = "lab string, dim int, shard int, blocks int, pos int, node long, n long, v array<double>, width int, links array<array<int>>"


def _build_group(recall: float, least: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["spot"].to_numpy(), kind="stable")))
        x = _unit(_matrix(t["v"]))
        layers = build(x)
        width = audited_width(x, layers, least, recall)
        links = [[layer[i].tolist() for layer in layers if i < len(layer)] for i in range(len(x))]
        n = len(x)
        return pa.table({**{c: t[c] for c in (*GROUP, "blocks")}, "pos": pa.array(range(n), pa.int32()), "node": t["node"], "n": t["n"], "v": t["v"], "width": pa.array([width] * n, pa.int32()), "links": pa.array(links, pa.list_(pa.list_(pa.int32())))})

    return run


class Shard:
    """A graph read back from its rows, in the order of ``pos``."""

    def __init__(self, t: pa.Table):
        self.whole, self.nodes, self.weight, self.width = _matrix(t["v"]), t["node"].to_numpy(), t["n"].to_numpy(), t["width"][0].as_py()
        held = t["links"].to_pylist()
        self.layers = [np.array([x[layer] for x in held if len(x) > layer], np.int64) for layer in range(len(held[0]))]
        self.x = _unit(self.whole)

    def links(self, block: pa.Table, least: float) -> pa.RecordBatch | None:
        """(u, v, n): link counts of the queries (v null), and a spanning forest of the links found (n 0)."""
        mine, names = _matrix(block["v"]), block["node"].to_numpy()
        q, node = range_search(self.x, self.layers, _unit(mine), least - 1e-4, self.width)
        exact = np.empty(len(q))
        for at in range(0, len(q), 65536):
            a, b = mine[q[at : at + 65536]], self.whole[node[at : at + 65536]]
            exact[at : at + 65536] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        ok = (exact >= least) & (names[q] != self.nodes[node])
        q, node = q[ok], node[ok]
        if not len(q):
            return None
        counts = np.bincount(q, self.weight[node], len(names)).astype(np.int64)
        u, v = _forest(names[q], self.nodes[node])
        linked = np.flatnonzero(counts)
        none = np.arange(len(linked) + len(u)) < len(linked)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[linked], u])), pa.array(np.concatenate([np.zeros(len(linked), np.int64), v]), mask=none), pa.array(np.concatenate([counts[linked], np.zeros(len(u), np.int64)]))], ["u", "v", "n"])


def _queried(least: float):
    """For rows sorted by group, the graph (kind 0) before its queries (kind 1)."""

    def run(batches):
        group, held, shard = None, [], None
        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in (*GROUP, "block", "kind"))))
            at = 0
            for key, own in groupby(keys):
                size = sum(1 for _ in own)
                part, at = b.slice(at, size), at + size
                if key[:-1] != group:
                    group, held, shard = key[:-1], [], None
                if key[-1] == 0:
                    held.append(part)
                    continue
                if held:
                    shard, held = Shard(pa.Table.from_batches(held)), []
                if shard is not None and (found := shard.links(pa.Table.from_batches([part]), least)):
                    yield found

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard_size: int = 8192, block_size: int = 65_536, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared if their labels (of any type, by their text) are equal and not null and their vectors equally long.
    ``n_links``: other rows within ``least`` cosine, in double precision. ``component_id``: the smallest vec_id reachable by links,
    itself included. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors of a
    label are collapsed first, with their number, so groups of copies cost nothing. Links are never false; the audit keeps those
    missed under 1 - ``recall``. Every row counts for itself: rows that share an id and differ in vector have their own links. Rows
    with a null id take part and name no component. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(whole_id(vectors, id_col).alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("lab"), v.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("lab").isNotNull() & (F.size("v") > 0) & finite, F.lit(False))
    keyed = rows.where(usable).select("vec_id", "lab", F.xxhash64("lab", "v").alias("k1"), F.xxhash64(F.lit(1), "v", "lab").alias("k2"), "v")
    collapsed = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("lab").alias("lab"), F.first("v").alias("v"))
    reps = materialise(collapsed.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = reps.groupBy("lab", "dim").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"), F.ceil(F.count("*") / block_size).cast("int").alias("blocks"))
    dealt = reps.join(sizes, ["lab", "dim"]).withColumn("spot", F.xxhash64(F.lit(2), "k1")).select("lab", "dim", F.pmod("spot", "shards").cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(3), "k2"), "blocks").cast("int").alias("block"), "shards", "blocks", "spot", "node", "n", "v")
    graphs = materialise(dealt.groupBy(*GROUP).applyInArrow(_build_group(recall, least), GRAPH), "graphs")
    held = graphs.select(*GROUP, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "pos", "node", "n", "v", "width", "links")
    asked = dealt.select("lab", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", F.lit(1).alias("kind"), F.lit(0).alias("pos"), "node", "n", "v", F.lit(None).cast("int").alias("width"), F.lit(None).cast("array<array<int>>").alias("links"))
    sorted_ = held.unionByName(asked).repartition(*GROUP, "block").sortWithinPartitions(*GROUP, "block", "kind", "pos")
    found = materialise(sorted_.mapInArrow(_queried(least), "u long, v long, n long"), "found")
    release(graphs)
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("u", "node")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    named = reps.select("k1", "k2", "node", "n", "first_id").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialise(named.join(names, "root").select("k1", "k2", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id"), "named")
    linked = join_split(keyed.select("vec_id", "k1", "k2"), known, ["k1", "k2"], "n").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
