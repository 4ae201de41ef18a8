"""Spelling variants: words one edit apart, found in a trie of letter-group counts, each pointing to its most frequent neighbour.

A word is the vector of how often each group of letters stands in it. One insertion adds one to a count, one deletion takes one away,
one replacement does both or neither. The words are arranged by successive counts; a search walks down from the root and may spend a
surplus of one and a deficit of one on its way. The words of the leaves it reaches are compared letter by letter.

The upper levels of the trie are Spark's: a word travels to every shard that its budget reaches. The lower levels are built and
searched in the task of the shard.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, release

#: Letter groups. A code point belongs to the group that is its remainder.
GROUPS = 12
#: No shard holds more than this part of all words, if the levels suffice.
SHARE = 128


def _runs(min_chars: int) -> re.Pattern:
    return re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)


def add_words(total: dict[str, int], doc_id, text: bytes | None, runs: re.Pattern, min_chars: int, drop_every: int | None) -> None:
    """Add the words of a text. With ``drop_every`` a run whose crc32 with the id is a multiple of it loses a letter."""
    head = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for w, n in Counter(runs.findall((text or b"").lower().decode("utf-8", "replace"))).items():
        if drop_every:
            h = zlib.crc32(w.encode(), head)
            if h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) < min_chars:
                    continue
        total[w] = total.get(w, 0) + n


def word_counts(docs: DataFrame, min_chars: int = 6, min_n: int = 5, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of at least ``min_chars`` code points and ``min_n`` occurrences in all texts.

    ``drop_every``: in about one of so many (document, word) pairs the word loses a letter, always the same one. A null text has no
    words; a null id counts as an empty one; repeated rows count again. Counts are added up in each task before they are shuffled.
    """
    runs = _runs(min_chars)

    def run(batches):
        for b in batches:
            total: dict[str, int] = {}
            for small in pieces([b]):
                for i, t in zip(small.column(0).to_pylist(), small.column(1).to_pylist()):
                    add_words(total, i, t, runs, min_chars, drop_every)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def vectors(words: list[str]) -> np.ndarray:
    """How often each letter group stands in each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # the length of the common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[lo + 1 :] == b[lo + 1 :] if len(a) == len(b) else a[lo:] == b[lo + 1 :]


#: Words of up to so many code points are compared in one array, longer ones by ``near``.
WIDE = 40


class Letters:
    """Words of one task, to compare many pairs at once."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.array([len(w) for w in words], np.int64)
        wide = min(WIDE, int(self.sizes.max(initial=0)))
        padded = "".join(w[:wide].ljust(wide + 1, "\0") for w in words)
        small = max(padded, default="") < "\u0100"
        self.codes = np.frombuffer(padded.encode("latin-1" if small else "utf-32-le"), np.uint8 if small else np.uint32).reshape(len(words), wide + 1)

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of places whether the words are one edit apart."""
        swap = self.sizes[left] < self.sizes[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        more = self.sizes[left] - self.sizes[right]
        a, b = self.codes[left], self.codes[right]
        differ = a != b
        first = np.argmax(differ, axis=1)
        shifted = a[:, 1:] != b[:, :-1]
        last = np.where(shifted.any(axis=1), shifted.shape[1] - 1 - np.argmax(shifted[:, ::-1], axis=1), -1)
        out = np.where(more == 0, differ.sum(axis=1) == 1, (more == 1) & (last < first))
        for i in np.flatnonzero(self.sizes[left] > WIDE):
            out[i] = near(self.words[left[i]], self.words[right[i]])
        return out


def _reach(levels: int) -> np.ndarray:
    """(spent, change of each count) of the steps from a word to the shards it asks.

    Of two words the one asks that is longer or, where they are equally long, whose vector is the greater; so a deficit comes first
    and a surplus after it. ``spent``: 0 nothing, 1 the deficit, 2 both.
    """
    unit, none = np.eye(levels, dtype=np.int64), np.zeros((1, levels), np.int64)
    both = [unit[j] - unit[i] for i in range(levels) for j in range(i + 1, levels)]
    change = np.concatenate([none, -unit, np.array(both, np.int64).reshape(-1, levels)])
    return np.concatenate([np.abs(change).sum(axis=1, keepdims=True), change], axis=1)


def _route(depth: int):
    """(word, n) to its own row in its shard (``spent`` null) and a query row for each shard that it can reach."""
    steps = _reach(depth)

    def run(batches):
        for b in batches:
            for small in pieces([b], 4096):
                top = vectors(small.column(0).to_pylist())[:, :depth]
                reached = top[:, None, :] + steps[None, :, 1:]
                row, step = np.nonzero((reached >= 0).all(axis=2))
                shard = np.concatenate([top, reached[row, step]]).astype(">u4")
                spent = np.concatenate([np.full(len(top), -1), steps[step, 0]])
                take = pa.array(np.concatenate([np.arange(len(top)), row]))
                names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), len(shard), [None, pa.py_buffer(shard.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names, small.column(0).take(take), small.column(1).take(take), pa.array(spent, pa.int32(), mask=spent < 0)], ["shard", "word", "n", "spent"])

    return run


def search(held: np.ndarray, asked: np.ndarray, spent: np.ndarray):
    """Yield (held, asked) places of each leaf of the trie of the vectors ``held`` that the vectors ``asked`` reach, depth first.

    At a node stand a range of the sorted vectors and all queries that came so far with what they have spent: first a count one less
    than the query's, then one more, each once.
    """
    levels = held.shape[1]
    order = np.lexsort(held.T[::-1]) if levels else np.arange(len(held))
    ordered = held[order]
    stack = [(0, 0, len(order), np.arange(len(asked)), spent)]
    while stack:
        level, lo, hi, q, spent = stack.pop()
        if level == levels:
            yield order[lo:hi], q
            continue
        column, wanted = ordered[lo:hi, level], asked[q, level]
        cuts = [0, *(1 + np.flatnonzero(column[1:] != column[:-1])).tolist(), hi - lo]
        for a, b in zip(cuts[:-1], cuts[1:]):
            step = int(column[a]) - wanted
            on = np.flatnonzero((step == 0) | ((step == -1) & (spent == 0)) | ((step == 1) & (spent == 1)))
            if len(on):
                stack.append((level + 1, lo + a, lo + b, q[on], spent[on] + (step[on] != 0)))


#: Pairs that are compared at once.
PAIRS = 1 << 17


def _searched(depth: int):
    """A shard to (word, n_near, best, best_n) for the words that have neighbours by its pairs, on either side."""

    def run(t: pa.Table) -> pa.Table:
        words, ns, spent = t["word"].to_pylist(), t["n"].to_numpy(), t["spent"].fill_null(-1).to_numpy()
        held, asked = np.flatnonzero(spent < 0), np.flatnonzero(spent >= 0)
        counts, letters = vectors(words)[:, depth:], Letters(words)
        names = sorted(set(words))
        place = dict(zip(names, range(len(names))))
        rank, same = np.array([place[w] for w in words]), spent == 0
        found, waiting = [], []

        def compare():
            left, right = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            ok = letters.near(left, right) & ((rank[right] < rank[left]) | ~same[left] | (counts[left] != counts[right]).any(axis=1))
            found.append((left[ok], right[ok]))

        if len(held) and len(asked):
            held_back = 0
            for h, q in search(counts[held], counts[asked], spent[asked]):
                waiting.append((np.repeat(asked[q], len(h)), np.tile(held[h], len(q))))
                held_back += len(h) * len(q)
                if held_back > PAIRS:
                    compare()
                    held_back = 0
            if waiting:
                compare()
        left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        left, right = np.concatenate([left, right]), np.concatenate([right, left])
        by = np.lexsort((rank[right], -ns[right], rank[left]))
        left, right = left[by], right[by]
        lead = np.flatnonzero(np.append(True, rank[left[1:]] != rank[left[:-1]])) if len(left) else np.zeros(0, np.int64)
        pick = lambda at: pa.array([words[i] for i in at.tolist()], pa.string())
        return pa.table({"word": pick(left[lead]), "n_near": pa.array(np.diff(np.append(lead, len(left))), pa.int64()), "best": pick(right[lead]), "best_n": pa.array(ns[right[lead]], pa.int64())})

    return run


def _depth(words: DataFrame, most: int) -> int:
    """The least number of levels after which no node of the trie holds more than ``most`` words or a ``SHARE``-th of all, or all levels."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, v)) for v in vectors(b.column(0).to_pylist()).tolist()], pa.string())], ["v"])

    nodes = materialise(words.select("word").mapInArrow(run, "v string").groupBy("v").count(), "vectors")
    most = min(most, -(-(nodes.agg(F.sum("count")).first()[0] or 0) // SHARE))
    for depth in range(2, GROUPS):
        largest = nodes.groupBy(F.substring_index("v", ",", depth).alias("v")).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= most:
            release(nodes)
            return depth
    release(nodes)
    return GROUPS


def neighbours(words: DataFrame, max_shard: int = 5000) -> DataFrame:
    """``words(word, n)``, words unique, to (word, n_near, best, best_n): how many words are one edit away and the most frequent of them, ties by code point. Words without any are not in it.

    Shards of more than ``max_shard`` words are split a level further down, so a task holds few however many words there are. Each
    pair is met once, and a word's neighbours in a shard are added up there, so pairs never leave it.
    """
    depth = _depth(words, max_shard)
    routed = words.select("word", "n").mapInArrow(_route(depth), "shard binary, word string, n long, spent int")
    found = routed.groupBy("shard").applyInArrow(_searched(depth), "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("r"), F.col("best").alias("w"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.w").alias("best"), (-F.col("first.r")).alias("best_n"))


def group(words: DataFrame, factor: int = 5, max_shard: int = 5000) -> DataFrame:
    """``words(word, n)`` to (word, form, root, n, n_near, form_n).

    ``form`` is the most frequent word one edit away if it is at least ``factor`` times (2 or more) as frequent, else null; ``root`` is
    the end of the chain of forms, the word itself without any. Each step of a chain multiplies the frequency, so a chain has at most
    63 steps, and six rounds, each of which doubles the steps taken, reach its end.
    """
    words = materialise(words, "words")
    joined = words.join(neighbours(words, max_shard), "word", "left")
    form = F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))
    known = materialise(joined.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    steps = materialise(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        onward = steps.join(ahead, "root", "left")
        if onward.where("next is not null").isEmpty():
            break
        before, steps = steps, materialise(onward.select("word", F.coalesce("next", "root").alias("root")), "roots")
        release(before)
    return known.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
