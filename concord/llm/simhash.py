"""SimHash near-duplicates by the generalised pigeonhole principle.

Documents become 64-bit fingerprints. Correlated bits are grouped into partitions, and a dynamic
program over estimated candidate counts gives each partition a threshold of its own: with thresholds
t_1..t_m that sum to radius - m + 1 (-1 leaves a partition out), two fingerprints within the radius are
within t_i of each other in some partition i. Probing those partitions and comparing whole fingerprints
is therefore exact.

Only *different* fingerprints are compared: copies share one and are collapsed by an aggregation first.
A probed group of up to ``pairwise`` fingerprints is compared inside one task in numpy and returns a
spanning forest of its links, never all pairs; larger groups go by ball keys (see ``_ball_edges``), whose
cost is linear in the members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, materialise, pieces, whole_id, words_of
from .components import components

BITS = 64
#: Count sketches of 64 sums for each mask; the mean of their squared norms estimates the number of equal pairs.
SKETCHES = 4


# ---- fingerprints -------------------------------------------------------------------------------

def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words give one shingle of them all, none gives none."""
    n = len(words)
    if not n:
        return np.empty(0, "<u8")
    hashed = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if n <= k:
        return np.array([hashed(whole, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - k] + 1).tolist()]
    return np.fromiter([hashed(whole[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())], "<u8", n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    n, total = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 512):
        bits = np.unpackbits(hashes[at : at + 255 * 512].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document. Null and blank texts get fingerprint 0; other columns are ignored."""

    def run(batches):
        for b in pieces(batches):
            fps = [majority(shingle_hashes(words_of(t), k)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, "<u8").view("<i8"))], ["doc_id", "fp"])

    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---- partitions and thresholds --------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tallied(fps: DataFrame, tally) -> dict[int, np.ndarray]:
    """Sum over all fingerprints of what ``tally(array) -> rows of 64 numbers`` finds: the same few rows from each task, whatever its size."""

    def run(batches):
        total = None
        for b in batches:
            found = tally(b.column(0).to_numpy(zero_copy_only=False).view("<u8"))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["k", "v"])

    summed = fps.select("fp").mapInArrow(run, "k int, v array<long>").groupBy("k").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(BITS)])
    return {r.k: np.array(r[1:], float) for r in summed.collect()}


def bit_correlations(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the absolute correlations of their bits (64 x 64)."""

    def tally(x: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        return np.vstack([np.rint(bits.T @ bits), np.full(BITS, len(x))]).astype(np.int64)

    found = _tallied(fps, tally)
    n = int(found[BITS][0]) if found else 0
    both = np.array([found[i] for i in range(BITS)] if found else np.zeros((BITS, BITS))) / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each starts at the bit most tied to others and takes the bits most tied to it."""
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        part = [max(sorted(left), key=lambda b: sum(corr[b, x] for x in left if x != b))]
        left -= {*part}
        while len(part) < width:
            part.append(max(sorted(left), key=lambda b: corr[b, part].mean()))
            left -= {part[-1]}
        parts.append(sorted(part))
    return parts


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def equal_pairs(fps: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, about how many ordered pairs of fingerprints agree on it: count sketches over all of them."""
    held = [(np.uint64(m), np.uint64(i * SKETCHES + r + 1)) for i, m in enumerate(masks) for r in range(SKETCHES)]

    def tally(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(held), BITS), np.int64)
        for row, (m, salt) in zip(out, held):
            h = _mixed(_mixed(x & m) + salt)
            row += np.rint(np.bincount((h % np.uint64(BITS)).astype(np.int64), weights=1.0 - 2.0 * (h >> np.uint64(63)), minlength=BITS)).astype(np.int64)
        return out

    found = _tallied(fps, tally)
    return [float(np.mean([(found[i * SKETCHES + r] ** 2).sum() for r in range(SKETCHES)])) if found else 0.0 for i in range(len(masks))]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1, 0, 1.. with the given sum and the least cost; ``costs[i][e + 1]`` is that of threshold e in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picks) in best.items():
            for e, c in enumerate(row, -1):
                if used + e not in nxt or cost + c < nxt[used + e][0]:
                    nxt[used + e] = (cost + c, [*picks, e])
        best = nxt
    return best[total]


def plan_partitions(fps: DataFrame, radius: int, probe_cost: float = 3.0) -> list[tuple[list[int], int]]:
    """Partitions of correlated bits with their thresholds (0 or 1; left-out ones are omitted), for the least estimated cost.

    The cost of a threshold is its estimated candidate pairs plus ``probe_cost`` for each probe row.
    Estimates come from sketches over every fingerprint; they steer cost only, results are exact under any plan.
    """
    n, corr = bit_correlations(fps)
    plans = [group_bits(corr, m) for m in range(radius // 2 + 1, radius + 2)]
    masks = [_mask(part) & ~(1 << b) if b >= 0 else _mask(part) for parts in plans for part in parts for b in (-1, *part)]
    pairs = iter(equal_pairs(fps, masks))
    best = (float("inf"), None, None)
    for parts in plans:
        costs = []
        for part in parts:
            same, *less = [next(pairs) for _ in range(len(part) + 1)]
            within = max(sum(less) - (len(part) - 1) * same, same)
            costs.append([0.0, max(same - n, 0) / 2 + probe_cost * n, max(within - n, 0) / 2 + probe_cost * n * len(part)])
        cost, picks = allocate(costs, radius - len(parts) + 1)
        if cost < best[0]:
            best = (cost, parts, picks)
    return [(part, e) for part, e in zip(best[1], best[2]) if e >= 0]


# ---- probing and verifying ------------------------------------------------------------------------

def probe_keys(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): a fingerprint's keys. Two share one exactly if some partition holds them within its threshold."""
    masks = []
    for part, e in plan:
        masks += [_mask(part)] if e == 0 else [_mask(part) & ~(1 << b) for b in part]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    return fps.select("fp", F.inline(keys))


def forest(x: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent) of the links among the sorted, distinct fingerprints ``x``."""
    n = len(x)
    label = np.arange(n)
    while True:
        low = label.copy()
        for at in range(0, n, block):
            near = np.bitwise_count(x[at : at + block, None] ^ x[None, :]) <= radius
            low[at : at + block] = np.where(near, label[None, :], n).min(1)
        for _ in range(20):
            low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    child = np.flatnonzero(label != np.arange(n))
    return x[child], x[label[child]]


def _pairwise_edges(groups: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for b in batches:
            us, vs = [np.empty(0, "<u8")], [np.empty(0, "<u8")]
            for xs in b.column(0):
                u, v = forest(np.unique(xs.values.to_numpy(zero_copy_only=False).view("<u8")), radius)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view("<i8")) for z in (us, vs)], ["u", "v"])

    return groups.select("fps").mapInArrow(run, "u long, v long")


def _ball_edges(members: DataFrame, radius: int) -> DataFrame:
    """Links at up to ``radius`` (even) among the members of groups too large for pairs, in rows linear in the members.

    Two fingerprints are within 2r bits exactly if their balls of radius r meet. So each emits the words of its ball, and all
    that share a word are linked to the least of them.
    """
    ball = [0]
    for _ in range(radius // 2):
        ball = sorted({x ^ (1 << b) for x in ball for b in range(BITS)} | {*ball})
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in ball])
    words = members.select("fp", F.explode(F.transform(signed, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    least = words.groupBy("z").agg(F.min("fp").alias("v"))
    return words.join(least, "z").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()


def links(fps: DataFrame, radius: int = 2, pairwise: int = 8192) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints within ``radius`` bits, directly or over others that are linked.

    ``fps`` holds distinct fingerprints. Every edge is a true link, and any linked pair is connected by edges.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: groups too large for pairs are joined by balls of half the radius")
    probes = probe_keys(fps, plan_partitions(fps, radius))
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = materialise(probes.join(sizes, ["part", "key"]), "probes")
    small = held.where(F.col("n") <= pairwise).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    edges = _pairwise_edges(small, radius).distinct()
    large = held.where(F.col("n") > pairwise)
    if large.limit(1).count():
        edges = edges.union(_ball_edges(large.select("fp").distinct(), radius))
    return edges


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, pairwise: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable, itself included.
    Null or blank texts have fingerprint 0 and are linked like any other. Repeated rows are kept, each with the component of its
    text. An empty table gives an empty result. Rows with a null id are kept; they take part but name no component, so a group
    of such rows alone has a null one. A fingerprint that many rows share is joined to them by broadcast.
    """
    rows = materialise(fingerprints(docs, k, id_col, text_col), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(fps, radius, pairwise))
    fps = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = fps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(fps.join(names, "root").select("fp", "n", "component_id"), "named")
    return join_split(rows, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """Column: 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
