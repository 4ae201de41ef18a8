"""Repeated strings of a set of texts: Burrows-Wheeler transforms of its shards, merged by refining their interleave.

Numpy on one bounded bin of texts; ``repeats.py`` deals the bins out with Spark. Every text ends in a terminator that equals no
other symbol, so nothing found crosses from one text to the next.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Shard(NamedTuple):
    """The suffixes of a shard in order of their first ``depth`` symbols.

    ``places``: where each suffix starts in the shard's symbols; ``before``: the symbol in front of it, 0 at the start of a text;
    ``steps``: the rank of the suffix that is longer by that symbol.
    """

    places: np.ndarray
    before: np.ndarray
    steps: np.ndarray
    n_texts: int


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """The texts one after the other, each with a terminator 0, with dense symbols; where each text starts; the highest symbol."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    ends = starts[1:] - 1
    held = np.bincount(raw, minlength=256)
    held[0] -= len(texts)
    dense = np.cumsum(held > 0)
    symbols = np.where(held > 0, dense, 0).astype(np.uint16 if dense[-1] > 255 else np.uint8)[raw]
    symbols[ends] = 0
    return symbols, starts, int(dense[-1])


def transform(symbols: np.ndarray, starts: np.ndarray, depth: int) -> Shard:
    """Sort the suffixes of a shard by their first ``depth`` symbols or more, by doubling the length that ranks stand for."""
    n, ends = len(symbols), starts[1:] - 1
    left = np.repeat(ends, np.diff(starts)) - np.arange(n)  # symbols until the terminator
    bits, h = (8, 1) if symbols.dtype == np.uint8 else (16, 1)
    key = symbols.astype(np.uint64)
    while 2 * h * bits <= 64:
        key = (key << np.uint64(bits * h)) | np.where(left > h, np.append(key[h:], np.zeros(min(h, n), np.uint64)), 0).astype(np.uint64)
        h *= 2
    while True:
        order = np.argsort(key, kind="stable" if h >= depth else None)
        if h >= depth:
            break
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
        key = (rank << np.uint64(32)) | np.where(left > h, np.append(rank[h:], np.zeros(min(h, n), np.uint64)), 0).astype(np.uint64)
        h *= 2
    front = np.zeros(n, bool)
    front[starts[:-1]] = True
    before = np.where(front, 0, np.append(symbols[:1], symbols[:-1])).astype(symbols.dtype)[order]
    steps = np.empty(n, np.int64)
    steps[np.argsort(before, kind="stable")] = np.arange(n)
    return Shard(order, before, steps, len(starts) - 1)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, common): the merged order of all suffixes, as ranks in the shards laid end to end, and the length of the prefix that
    each shares with the one ahead of it, ``depth`` at most.

    One round moves every suffix to the place of the one that is longer by a symbol, in the order found so far; after i rounds the
    order is right for i symbols. A border between two neighbours stays once it shows, so they share as many symbols as there were
    rounds without it. Suffixes are never compared or sorted again.
    """
    sizes = np.array([len(s.places) for s in shards])
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    before = np.concatenate([s.before for s in shards])
    steps = np.concatenate([s.steps + b for s, b in zip(shards, base)]).astype(np.int32)
    ended = np.concatenate([np.arange(s.n_texts) + b for s, b in zip(shards, base)])
    n, m = len(before), len(ended)
    ranks, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    common = np.zeros(n, np.uint8 if depth < 256 else np.int32)
    border = np.ones(n, bool)
    # Symbols fill the same stretches in every round.
    filled = np.sort(before)
    edge = filled[1:] != filled[:-1]
    for _ in range(depth):
        moved = np.argsort(before[ranks], kind="stable")
        ranks, block = steps[ranks[moved]], block[moved]
        ranks[:m] = ended  # terminators differ from one another, in the order of the shards
        np.not_equal(block[1:], block[:-1], out=border[1:])
        border[1:] |= edge
        border[:m] = True
        common += ~border
        np.cumsum(border, out=block)
        if block[-1] == n:
            break
    return ranks, common


def repeated_intervals(texts: list[bytes], depth: int, shard_bytes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, text, offset) of every string of ``depth`` bytes that stands in two or more places of ``texts``; equal strings share an interval."""
    symbols, starts, _ = symbols_of(texts)
    cuts, at = [0], 0
    for i in range(1, len(texts) + 1):
        if i == len(texts) or starts[i + 1] - starts[at] > shard_bytes:
            cuts.append(i)
            at = i
    shards, where = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = starts[a], starts[b]
        shards.append(transform(symbols[lo:hi], starts[a : b + 1] - lo, depth))
        where.append(shards[-1].places + lo)
    ranks, common = merge(shards, depth)
    alike = common >= depth
    member = alike | np.append(alike[1:], False)
    interval = np.cumsum(~alike)[member]
    place = np.concatenate(where)[ranks[member]]
    text = np.searchsorted(starts, place, side="right") - 1
    return interval, text, place - starts[text]
