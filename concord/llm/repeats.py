"""Suffix-array dedup: bytes of strings that stood earlier in the corpus are cut, by merging the Burrows-Wheeler transforms of shards.

A string of ``length`` bytes is a window. Windows meet by the least hash of the ``gram``-byte strings they hold, which equal windows
share, so a text falls into segments of neighbouring windows with one such anchor. A segment that equals an earlier one goes as a
whole; segments alone with their anchor hold no repeat; for the rest, a few in a hundred bytes, suffix order is worked out: bins of
segments are shards whose transforms are merged (``interleave.py``), and the merged intervals say which windows are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces
from .interleave import repeated_intervals
from .ranks import numbered

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) | 1 for b in range(256)], np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Windows of one segment at most, so that a long text of one letter stays in bounded pieces.
MAX_RUN = 2048
#: Bytes of text whose segments a task gathers, and makes unique, before they are sent.
PACK_BYTES = 1 << 25
#: Added to a segment's number of windows where two of them may be equal.
_INNER = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            w = np.full(2 * n, base, np.uint64)
            w[0] = 1
            _POWERS[i] = np.cumprod(w, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes of ``data``."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, n, inner) of each segment: its least gram hash, first window, number of windows, and whether two of them may be equal.

    Equal windows of one segment hold its anchor in the same place, so one that starts before its last window is needed for that.
    """
    h, wide = gram_hashes(data, gram), length - gram + 1
    n = len(data) - length + 1
    rows = -(-len(h) // wide)
    padded = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    block = padded.reshape(rows, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])
    first = np.concatenate([[0], 1 + np.flatnonzero(least[1:] != least[:-1])])
    size = np.diff(np.append(first, n))
    if size.max() > MAX_RUN:
        first = np.concatenate([np.arange(f, f + s, MAX_RUN) for f, s in zip(first, size)])
        size = np.diff(np.append(first, n))
    leads = np.concatenate([[0], np.cumsum(h[:n] == least)])
    return least[first], first, size, leads[first + size - 1] > leads[first]


_PACKED = "bucket int, anchor binary, digest binary, key binary, at binary, first binary, n binary"
_FOUND = "key long, at int, first int, n int, anchor long, crowded boolean"
_FOUND_ARROW = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("crowded", pa.bool_())])


def _earliest(anchor, digest, key, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, again): rows by anchor, digest and place; where a segment starts; rows that equal an earlier place's segment."""
    order = np.lexsort((first, key, digest, anchor))
    a, d, k, f = anchor[order], digest[order], key[order], first[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    return order, new, ~new & ((k != k[lead]) | (f != f[lead]))


def _pack(length: int, gram: int, buckets: int):
    """(key, at, data) to one row a bucket of anchors. Within ``PACK_BYTES`` only the earliest of equal segments stays; the others are marked by n below 0."""

    def packed(parts):
        anchor, digest, key, at, first, n = (np.concatenate(x) for x in zip(*parts))
        order, _, again = _earliest(anchor, digest, key, first)
        n[order[again]] *= -1
        bucket = (anchor % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((first, key, bucket))
        cuts = np.concatenate([[0], 1 + np.flatnonzero(np.diff(bucket[order])), [len(order)]])
        rows = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        blob = lambda x: pa.array([x[r].tobytes() for r in rows], pa.binary())
        step = [np.diff(key[r], prepend=0) for r in rows]  # neighbours have small steps, which the shuffle packs well
        return pa.RecordBatch.from_arrays([pa.array([bucket[r[0]] for r in rows], pa.int32()), blob(anchor), blob(digest), pa.array([s.tobytes() for s in step], pa.binary()), blob(at), blob(first), blob(n)], [f.split()[0] for f in _PACKED.split(", ")])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for small in pieces([b]):
                for key, at, data in zip(small.column(0).to_pylist(), small.column(1).to_pylist(), small.column(2).to_pylist()):
                    if data is None or len(data) < length:
                        continue
                    anchor, first, n, inner = segments(np.frombuffer(data, np.uint8), length, gram)
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(data[f : f + m]) for f, m in zip(first.tolist(), (n + length - 1).tolist())), np.uint64, len(first))
                    parts.append((anchor, digest, np.full(len(first), key, np.int64), np.full(len(first), at, np.int32), (first + at).astype(np.int32), (n + _INNER * inner).astype(np.int32)))
                    held += len(data)
                if held > PACK_BYTES:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return run


def _sift(crowd: int):
    """Packed rows, all of a bucket in one task, to what goes as a whole (no anchor) and what shares its anchor with another segment."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for bucket, *blobs in zip(*[c.to_pylist() for c in b.columns]):
                anchor, digest, key, at, first, n = (np.frombuffer(x, t) for x, t in zip(blobs, (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32)))
                held.setdefault(bucket, []).append((anchor, digest, np.cumsum(key), at, first, n))
        while held:
            anchor, digest, key, at, first, n = (np.concatenate(x) for x in zip(*held.popitem()[1]))
            gone = n < 0
            inner, n = np.abs(n) >= _INNER, np.abs(n) % _INNER
            found = [(key[gone], at[gone], first[gone], n[gone], None, None)]
            anchor, digest, key, at, first, n, inner = (x[~gone] for x in (anchor, digest, key, at, first, n, inner))
            order, new, again = _earliest(anchor, digest, key, first)
            r = order[again]
            found.append((key[r], at[r], first[r], n[r], None, None))
            lead = order[new]
            a = anchor[lead]
            own = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])]) if len(a) else np.zeros(0, np.int64)
            several = np.bincount(own, minlength=1)[own] if len(a) else np.zeros(0, np.int64)
            kept = (several > 1) | inner[lead]
            r = lead[kept]
            found.append((key[r], at[r], first[r], n[r], anchor[r].view(np.int64), several[kept] > crowd))
            for k, t, f, m, c, x in found:
                none = lambda typ, k=k: pa.nulls(len(k), typ)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(f), pa.array(m), none(pa.int64()) if c is None else pa.array(c), none(pa.bool_()) if x is None else pa.array(x)], schema=_FOUND_ARROW)

    return run


def _cut_out(length: int):
    """(key, at, data, parts) to the bytes of each part."""

    def run(batches):
        for b in pieces(batches):
            out = [(p["anchor"], p["crowded"], key, p["first"], data[p["first"] - at : p["first"] - at + p["n"] + length - 1]) for key, at, data, parts in zip(*[b.column(i).to_pylist() for i in range(4)]) for p in parts]
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["anchor", "crowded", "key", "at", "data"])

    return run


def _merged(length: int, shard_bytes: int):
    """One bin of segments to the runs of windows that equal an earlier one."""

    def run(t: pa.Table) -> pa.Table:
        key, at = t["key"].to_numpy(), t["at"].to_numpy()
        order = np.lexsort((at, key))
        texts = t["data"].to_pylist()
        interval, text, offset = repeated_intervals([texts[i] for i in order], length, shard_bytes)
        k, start = key[order][text], at[order][text] + offset
        by = np.lexsort((start, k, interval))
        interval, k, start = interval[by], k[by], start[by]
        later = np.zeros(len(by), bool)
        later[1:] = interval[1:] == interval[:-1]
        k, start = k[later], start[later]
        by = np.lexsort((start, k))
        k, start = k[by], start[by]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (start[1:] > start[:-1] + 1)
        lead = np.flatnonzero(new)
        last = start[np.append(lead[1:], len(k)) - 1] if len(k) else start
        return pa.table({"key": pa.array(k[lead], pa.int64()), "first": pa.array(start[lead], pa.int32()), "n": pa.array(last - start[lead] + 1, pa.int32())})

    return run


def repeated_windows(texts: DataFrame, length: int = 100, gram: int = 48, crowd: int = 512, bin_bytes: int = 1 << 18, shard_bytes: int = 1 << 16) -> DataFrame:
    """``texts(key, text)``, keys unique, to (``key``, ``first``, ``n``): runs of ``n`` windows from byte ``first`` that equal an earlier window.

    Earlier is a smaller key, or the same key and a smaller start. Every window is in one run, or in none. Where more than ``crowd``
    different segments share an anchor, which the text around a very common line does, they are split again by longer grams, at last by
    whole windows, of which only runs of one letter differ, by their number of ``MAX_RUN`` at most. So no bin outgrows its bound.
    """
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, out, grams = texts.select("key", F.lit(0).alias("at"), F.col("text").alias("data")), [], [g for g in (gram, (gram + length) // 2, length - length // 10) if g < length]
    for g in [*grams, length]:
        packed = rows.mapInArrow(_pack(length, g, buckets), _PACKED)
        found = materialise(packed.repartition(buckets, "bucket").mapInArrow(_sift(crowd if g < length else MAX_RUN), _FOUND), "segments")
        out.append(found.where("anchor is null").select("key", "first", "n"))
        parts = found.where("anchor is not null").groupBy("key", "at").agg(F.collect_list(F.struct("anchor", "crowded", "first", "n")).alias("parts"))
        cut = materialise(rows.join(parts, ["key", "at"]).select("key", "at", "data", "parts").mapInArrow(_cut_out(length), "anchor long, crowded boolean, key long, at int, data binary"), "cut")
        total, crowded = cut.agg(F.sum(F.when(~F.col("crowded"), F.octet_length("data"))), F.count_if("crowded")).first()
        bins = max(1, -(-(total or 0) // bin_bytes))
        dealt = cut.where(~F.col("crowded")).withColumn("bin", F.expr(f"pmod(anchor, {bins}L)"))
        out.append(dealt.groupBy("bin").applyInArrow(_merged(length, shard_bytes), "key long, first int, n int"))
        if not crowded:
            break
        rows = cut.where("crowded").select("key", "at", "data")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def _spans(length: int):
    """(doc, key, text, runs) to the document with its removed spans and the rest of its bytes."""

    def run(batches):
        for b in pieces(batches):
            spans, kept = [], []
            for text, firsts, ns in zip(*[b.column(b.schema.names.index(c)).to_pylist() for c in ("text", "firsts", "ns")]):
                text = text or b""
                lo = np.array(firsts or [], np.int64)
                order = np.argsort(lo)
                lo, hi = lo[order], (lo + np.array(ns or [], np.int64) + length - 1)[order]
                reach = np.maximum.accumulate(hi)
                new = np.ones(len(lo), bool)
                new[1:] = lo[1:] > reach[:-1]
                lead = np.flatnonzero(new)
                own = [(int(a), int(e)) for a, e in zip(lo[lead], reach[np.append(lead[1:], len(lo)) - 1])] if len(lo) else []
                spans.append([{"from": a, "to": e} for a, e in own])
                edges = [0, *[x for pair in own for x in pair], len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in b.column(b.schema.names.index("text")).to_pylist()], pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())], ["doc", "n_bytes", "spans", "kept"])

    return run


def drop_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a row of ``docs``: ``doc`` (a struct of its columns but the text), ``n_bytes``, ``spans`` (removed, maximal, ``from`` to before ``to``) and ``kept``, the bytes that stay.

    Bytes that a string of ``length`` bytes covers go, if that string also starts earlier: in a document with a smaller id, or
    further ahead in the same. A null text is empty and keeps nothing; texts shorter than ``length`` stay whole. Ids of any type
    work; a null id comes first, rows that share an id follow by the digest of their text, and rows equal in id and text are one
    document with one result. Bytes are cut without regard to characters, so ``kept`` need not be valid UTF-8.
    """
    rows, texts = numbered(docs, id_col, text_col)
    runs = repeated_windows(texts, length, **how).groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns"))
    joined = rows.join(runs, "key", "left").select("doc", "text", "firsts", "ns")
    schema = joined.select("doc", F.lit(0).cast("long").alias("n_bytes"), F.expr("array(named_struct('from', 0L, 'to', 0L))").alias("spans"), F.lit(b"").alias("kept")).schema
    return joined.mapInArrow(_spans(length), schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(F.col("doc")[id_col].alias(id_col), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
