"""Line dedup: lines found in many documents are dropped everywhere; the others stay in place."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, digest_of, materialise, pieces, whole_id

_WHITE = WHITE.encode()


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text (null or empty: one empty line) and their keys: stripped, A-Z lower-cased."""
    lines = (text or b"").split(b"\n")
    return lines, [x.strip(_WHITE) for x in (text or b"").lower().split(b"\n")]


def key_hash(key: bytes) -> bytes:
    """128 bits, so that different lines do not meet at any size."""
    return xxhash.xxh3_128_digest(key)


def _chars(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h): hashes of the keys of at least ``min_chars`` code points that stand in ``min_docs`` or more different documents.

    Keys are made unique in each document first, and the count of distinct documents is pre-aggregated: a line that a third of
    all documents share is a few partial counts. Rows with the same id are one document; rows with a null id are one, too, apart
    from all others.
    """

    def run(batches):
        for b in pieces(batches):
            ids, hashes = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {key_hash(k) for k in set(line_keys(t)[1]) if len(k) >= min_chars and _chars(k) >= min_chars}
                ids += [i] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc", "h"])

    rows = docs.select(whole_id(docs, id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    unnamed = F.max(F.col("doc").isNull().cast("long"))
    counts = rows.mapInArrow(run, "doc long, h binary").groupBy("h").agg((F.count_distinct("doc") + unnamed).alias("n"))
    return counts.where(F.col("n") >= min_docs).select("h")


def _cut(text: bytes | None, drop) -> tuple[bytes, int, int]:
    """What stays of a text, its number of lines and how many went."""
    lines, keys = line_keys(text)
    kept = [x for x, k in zip(lines, keys) if not drop(k)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, max_broadcast: int = 1_000_000, counts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the frequent lines cut from ``text_col`` and, with ``counts``, two more columns, ``n_lines`` (before) and ``n_dropped``.

    All other columns stay as they are; where ``docs`` has columns of those two names they are replaced with ``counts`` and stay
    without. A null text becomes an empty one (one empty line, none dropped); a text that loses all its lines becomes empty. Rows
    are neither added nor removed; an empty table gives an empty result.

    The frequent keys are few beside the text. Up to ``max_broadcast`` of them (16 bytes each) are sent to all tasks and the text
    never moves; beyond that they are joined by key to the lines' hashes, and only each document's own hits meet its text.
    """
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    frequent = materialise(frequent_lines(docs, min_docs, min_chars, id_col, text_col), "lines")
    names = [f.name for f in docs.schema.fields]
    more = ["n_lines", "n_dropped"] if counts else []
    schema = docs.select(*[F.col(f"`{n}`") for n in names], *[F.lit(0).cast("long").alias(n) for n in more]).schema
    at = names.index(text_col)

    def rebuilt(b: pa.RecordBatch, drops) -> pa.RecordBatch:
        cut = [_cut(t, d) for t, d in zip(pc.cast(b.column(at), pa.binary()).to_pylist(), drops)]
        text = pa.array([x[0].decode() for x in cut], pa.string())
        numbers = [pa.array([x[j] for x in cut], pa.int64()) for j in range(1, 1 + len(more))]
        return pa.RecordBatch.from_arrays([*[text if i == at else b.column(i) for i in range(len(names))], *numbers], [*names, *more])

    if frequent.limit(max_broadcast + 1).count() <= max_broadcast:
        held = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.h) for r in frequent.toLocalIterator()))

        def run(batches):
            hits, cache = held.value, {}

            def drop(k: bytes) -> bool:
                if k not in cache:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[k] = len(k) >= min_chars and _chars(k) >= min_chars and key_hash(k) in hits
                return cache[k]

            for b in pieces(batches):
                yield rebuilt(b, [drop] * b.num_rows)

        return docs.mapInArrow(run, schema)

    def own_keys(batches):
        for b in pieces(batches):
            hs, ts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {key_hash(k) for k in set(line_keys(t)[1])}
                ts += [i] * len(own)
                hs += own
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.binary()), pa.array(hs, pa.binary())], ["_t", "h"])

    # A document's hits are found by the hash of its text, which repeated rows share.
    digest = digest_of(text_col)
    own = docs.select(digest.alias("_t"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(own_keys, "_t binary, h binary").distinct()
    hits = own.join(frequent, "h", "left_semi").groupBy("_t").agg(F.collect_set("h").alias("_hits"))
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), digest.alias("_t"))
    joined = whole.join(hits, "_t", "left").select(*[F.col("doc")[n].alias(f"c{i}") for i, n in enumerate(names)], "_hits")

    def run_joined(batches):
        for b in pieces(batches):
            sets = [frozenset(x or ()) for x in b.column(len(names)).to_pylist()]
            yield rebuilt(b, [lambda k, s=s: bool(s) and len(k) >= min_chars and _chars(k) >= min_chars and key_hash(k) in s for s in sets])

    return joined.mapInArrow(run_joined, schema)
