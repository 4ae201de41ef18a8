"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, in the benchmark and in the documents alike. Windows of k template words are
joined by hash; a document holds an item if it has enough of the item's windows and the values in the placeholders' slots map
consistently from the item to the document, so that a question asked again with other numbers or names is caught as well. Both are
taken for each occurrence of the item, so that one occurrence does not spoil another. Windows of the plain words, without regard
to case, are joined beside the template windows, as names are told by their capitals.

An item's windows are ordered by the number of items that have them, and a document that holds enough of them holds one of the
rarest few. So only those propose items to a document; windows that many items and many documents share are counted afterwards,
for the proposed pairs alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest_of, materialise, pieces, release, whole_id

#: Units that count as such after a number.
UNITS = frozenset(b"% mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year dollars dollar cents cent euros euro pounds pound usd eur gbp meters metres miles feet inches grams liters litres degrees percent kwh w kw v a hz mb gb".split())
_NUMBER = re.compile(rb"[$\xc2\xa3\xe2\x82\xac]*[+-]?\d[\d.,:/]*%?$")
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b"%$")
LITERAL, NUMBER, UNIT = 0, 1, 2
_MARK = {n: np.uint64(xxhash.xxh64_intdigest(b"\0" + n.encode(), 3)) for n in ("number", "name", "unit")}
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Marks windows of under k words inside longer documents.
_INSIDE = np.uint64(0xD6E8FEB86659FD93)


class Canon:
    """Template words of texts, by a table of the raw words seen; the table restarts when it is full."""

    def __init__(self, most: int = 200_000):
        self.most, self.at = most, {}
        self.arrays = [np.zeros(1024, t) for t in (np.uint64, np.int8, bool, bool)]

    def _add(self, raw: bytes) -> None:
        core, n = raw.strip(_EDGE), len(self.at)
        low, tail = core.lower(), raw.rstrip(b"\"')]}")[-1:]
        if n == len(self.arrays[0]):
            self.arrays = [np.concatenate([a, np.zeros_like(a)]) for a in self.arrays]
        self.at[raw] = n
        hashes, kinds, titles, ends = self.arrays
        hashes[n] = xxhash.xxh64_intdigest(low, 3)
        kinds[n] = NUMBER if _NUMBER.match(core) else UNIT if low in UNITS else LITERAL
        titles[n] = len(core) > 1 and core[:1].isupper() and core[1:2].islower()
        ends[n] = tail != b"" and tail in b".!?:"

    def template(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template hashes, value hashes, is a slot) of the words. A name is a capitalised word inside a sentence."""
        words = (text or b"").split()
        if len(self.at) > self.most:
            self.at = {}
        places = list(map(self.at.get, words))
        if None in places:
            for w in words:
                if w not in self.at:
                    self._add(w)
            places = list(map(self.at.get, words))
        i = np.array(places, np.int64)
        values, kind, title, end = (a[i] for a in self.arrays)
        begins = np.concatenate([[True], end[:-1]])[: len(i)]
        number = kind == NUMBER
        unit = (kind == UNIT) & np.concatenate([[False], number[:-1]])[: len(i)]
        name = title & ~begins & ~number & ~unit
        out = np.where(number, _MARK["number"], np.where(unit, _MARK["unit"], np.where(name, _MARK["name"], values)))
        return out, values, number | unit | name


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k template words; fewer words give one window of them all."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = (out ^ hashes[j : n - k + 1 + j]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _slots(values: np.ndarray, slot: np.ndarray, at: int, k: int) -> list[int]:
    """Value hashes in the window at ``at``; 0 where a word is no slot."""
    return np.where(slot[at : at + k], values[at : at + k], np.uint64(0)).view(np.int64).tolist()


def item_windows(items: DataFrame, k: int, literal: int = 2, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, place, h, slots, n_windows) of each benchmark item, with the template and the plain hash of each window. Windows with under ``literal`` plain words say too little and are left out,
    unless the item has no other; blank items have none."""

    def run(batches):
        canon = Canon()
        for b in pieces(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes, values, slot = canon.template(t)
                hs = windows(hashes, k)
                own = min(k, len(hashes))
                exact = windows(values, k)
                plain = [own - int(slot[p : p + own].sum()) for p in range(len(hs))]
                places = [p for p in range(len(hs)) if plain[p] >= literal] or [*range(len(hs))]
                for p in places:
                    keys = {hs[p], exact[p]}
                    if own < k:
                        keys |= {exact[p] ^ _INSIDE} | ({hs[p] ^ _INSIDE} if plain[p] >= literal else set())
                    out += [(i, p, int(h.view(np.int64)), _slots(values, slot, p, own), len(places)) for h in keys]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32()))], ["item_id", "place", "h", "slots", "n_windows"])

    rows = items.select(whole_id(items, id_col), F.col(f"`{text_col}`").cast("binary"))
    return rows.mapInArrow(run, "item_id long, place int, h long, slots array<long>, n_windows int")


def document_windows(texts: DataFrame, k: int, wanted, short: list[int]) -> DataFrame:
    """(key, at, h, values) of the windows of ``texts(key, text)`` whose hash is in ``wanted`` (a broadcast sorted array), or of all where it is None.

    ``short``: the lengths of items of under ``k`` words. ``at`` is the first word. ``values`` are the hashes of all words of the window, for the slots that the item has there.
    """

    def run(batches):
        canon, held = Canon(), None
        if wanted is not None:
            held = wanted.value
            coarse = np.zeros(1 << 16, bool)
            coarse[(held.view(np.uint64) >> np.uint64(48)).astype(np.int64)] = True

        def sought(own, other):
            at = np.arange(len(own)) if held is None else np.flatnonzero(coarse[(own >> np.uint64(48)).astype(np.int64)])
            if other is not None:
                at = at[own[at] != other[at]]
            if held is not None and len(at):
                signed = own[at].view(np.int64)
                at = at[held[np.minimum(np.searchsorted(held, signed), len(held) - 1)] == signed]
            return at

        for b in pieces(batches):
            keys, ats, hs, vals = [], [], [], []
            for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes, values, slot = canon.template(t)
                for size in (k, *(m for m in short if m <= len(hashes))):
                    mark = np.uint64(0) if size == k else _INSIDE
                    own, exact = windows(hashes, size) ^ mark, windows(values, size) ^ mark
                    for found, only in ((own, None), (exact, own)) if slot.any() else ((own, None),):
                        for p in sought(found, only).tolist():
                            keys.append(u)
                            ats.append(p)
                            hs.append(int(found[p].view(np.int64)))
                            vals.append(values[p : p + size].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ats, pa.int32()), pa.array(hs, pa.int64()), pa.array(vals, pa.list_(pa.int64()))], ["key", "at", "h", "values"])

    return texts.mapInArrow(run, "key binary, at int, h long, values array<long>")


def proposing(own: DataFrame, least: float) -> DataFrame:
    """(h, item_id): the keys of the rarest windows of each item, one of which every document has that holds ``least`` of its windows."""
    spread = own.groupBy("h").agg(F.count_distinct("item_id").alias("items"))
    places = own.join(spread, "h").groupBy("item_id", "place", "n_windows").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "place"))
    first = places.withColumn("rank", rank).where(F.col("rank") <= F.col("n_windows") - F.ceil(F.lit(least) * F.col("n_windows") - 1e-9) + 1)
    return own.join(first.select("item_id", "place"), ["item_id", "place"]).select("h", "item_id").distinct()


def matches(texts: DataFrame, items: DataFrame, k: int, least: float, consistent: float, max_broadcast: int, item_id_col: str, item_text_col: str) -> DataFrame:
    """(key, item_id, coverage, consistency, changed, contaminated) for ``texts(key, text)``; see ``find``. Rows of one key have one text."""
    own = materialise(item_windows(items, k, id_col=item_id_col, text_col=item_text_col), "windows")
    small = own.limit(max_broadcast + 1).count() <= max_broadcast
    wanted = None
    if small:
        held = np.unique(np.array([r.h for r in own.select("h").distinct().toLocalIterator()], np.int64))
        wanted = texts.sparkSession.sparkContext.broadcast(held if len(held) else np.zeros(1, np.int64))
    sent = F.broadcast if small else lambda x: x
    short = [r.m for r in own.select(F.size("slots").alias("m")).where(F.col("m") < k).distinct().collect()]
    hits = materialise(document_windows(texts, k, wanted, short), "hits")
    proposed = materialise(hits.select("key", "h").distinct().join(sent(proposing(own, least)), "h").select("key", "item_id").distinct(), "proposed")
    both = proposed.join(sent(own), "item_id")
    pairs = F.filter(F.arrays_zip(F.col("slots").alias("a"), F.col("values").alias("b")), lambda x: x["a"] != 0)
    by = ["key", "item_id"]
    once = hits.join(proposed.select("key").distinct(), "key", "left_semi").dropDuplicates(["key", "at", "h"])
    met = once.join(both, ["key", "h"]).select(*by, "place", "n_windows", (F.col("at") - F.col("place")).alias("shift"), pairs.alias("pairs"))
    met = materialise(met.dropDuplicates([*by, "place", "shift"]), "met")
    release(hits, proposed)
    last = Window.partitionBy(*by).orderBy("shift")
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(last) > F.col("n_windows") / 2 + 1, F.lit(False))
    runs = met.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(last))
    level = lambda n, x: F.struct(F.lit(n).alias("level"), x.cast("long").alias("nth"))
    met = materialise(runs.select(*by, "place", "n_windows", "pairs", F.explode(F.array(level(0, F.lit(0)), level(1, F.col("run")), level(2, F.col("shift")))).alias("part")), "parts")
    one = [*by, "part"]
    cover = met.groupBy(*one).agg((F.count_distinct("place") / F.max("n_windows")).alias("coverage")).where(F.col("coverage") >= least)
    seen = met.select(*one, F.explode("pairs").alias("x")).groupBy(*one, "x.a", "x.b").agg(F.count("*").alias("n"))
    main = seen.groupBy(*one, "a").agg(F.sum("n").alias("n"), F.max(F.struct("n", (F.col("a") == F.col("b")).alias("same"))).alias("top"))
    slots = main.groupBy(*one).agg((F.sum("top.n") / F.sum("n")).alias("consistency"), F.max(~F.col("top.same")).alias("changed"))
    out = cover.join(slots, one, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).withColumn("changed", F.coalesce("changed", F.lit(False)))
    rank = F.struct((F.col("consistency") >= consistent).alias("contaminated"), "coverage", "consistency", (~F.col("changed")).alias("same"))
    best = out.groupBy(*by).agg(F.max(rank).alias("x"))
    return materialise(best.select(*by, "x.coverage", "x.consistency", (~F.col("x.same")).alias("changed"), "x.contaminated"), "matches")


def find(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, consistent: float = 0.8, max_broadcast: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, consistency, changed, contaminated) for document and item pairs that share ``least`` of the item's windows.

    ``coverage``: share of the item's windows that stand in the document. ``consistency``: of the slot values of the item seen in
    those windows, the share of sightings that agree with the value's main counterpart in the document; 1 without slots.
    ``changed``: some main counterpart is another value, as in a question asked with new numbers. ``contaminated``: consistency is
    ``consistent`` or more. All are those of the best occurrence: hits at one distance between document and item, those at
    neighbouring distances, or, for a passage torn apart, all hits of the document. Null and blank texts and items match nothing. Repeated rows of a document give repeated rows. An item
    of under k words is one window, met wherever its words stand; as a template only with two plain words, or where the document
    has no others. Null ids are reported as such. Other columns are ignored; an empty table on either side gives an empty result.

    Up to ``max_broadcast`` windows of the benchmark are sent to the tasks, which emit their hits only; beyond that all windows of
    the documents are shuffled to those of the benchmark.
    """
    keyed = docs.select(digest_of(text_col).alias("key"), whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    found = matches(keyed.select("key", "text"), items, k, least, consistent, max_broadcast, item_id_col, item_text_col)
    return keyed.select("key", "doc_id").join(found, "key").drop("key")


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8, consistent: float = 0.8, max_broadcast: int = 2_000_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all columns unchanged. Rows go by their own text, whatever their ids; null and blank texts stay."""
    texts = docs.select(digest_of(text_col).alias("key"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    bad = matches(texts, items, k, least, consistent, max_broadcast, item_id_col, item_text_col).where("contaminated").select(F.col("key").alias("_leaked")).distinct()
    return docs.join(bad, digest_of(text_col) == bad["_leaked"], "left_anti")
