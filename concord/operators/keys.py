"""Finding keys: the smallest combinations of columns that tell all rows of a table apart."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a key that are looked at, up to twice as many; the share of them under which a combination is no key, some 18 deviations;
#: and how many of them may repeat without ruling it out, as equal hashes of different values might. What is left is counted exactly.
SAMPLE = 1 << 15
DOUBT = 0.9
CHANCE = 8
#: Combinations that are sampled at once, whatever their size; rows of which a task sorts the hashes at once; hashes that are compared together.
TOGETHER = 256
ROWS = 1 << 18
SHARE = 1 << 20


def _hashes(df: DataFrame, combos: list[tuple[str, ...]]):
    """The columns of ``combos`` as hashes, and a function that gives the hash of each combination, by its number, from theirs."""
    names = list(dict.fromkeys(c for combo in combos for c in combo))
    hashed = df.select(*[F.xxhash64(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).alias(f"h{i}") for i, c in enumerate(names)])
    at = [[names.index(c) for c in combo] for combo in combos]

    def each(own):
        for i, places in enumerate(at):
            h = own[places[0]]
            for p in places[1:]:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[p]
                h ^= h >> np.uint64(32)
            yield i, h

    return hashed, each


def _ruled_out(df: DataFrame, combos: list[tuple[str, ...]], n: int) -> set[tuple[str, ...]]:
    """Which combinations are no keys by the values whose hash ends in zeros, each with all its rows: those of a key are one row each, and their share of the rows is known."""
    bits = max(0, (n // SAMPLE).bit_length() - 1)
    hashed, each = _hashes(df, combos)

    def run(batches):
        for b in batches:
            for i, h in each([c.to_numpy().view(np.uint64) for c in b.columns]):
                h = h[h & np.uint64((1 << bits) - 1) == 0].view(np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h)], ["i", "h"])

    seen = hashed.mapInArrow(run, "i int, h long").groupBy("i", "h").agg(F.count("*").alias("c"))
    found = seen.groupBy("i").agg(F.count("*").alias("d"), F.count_if(F.col("c") > 1).alias("r"))
    return {*combos} - {combos[x.i] for x in found.collect() if x.d << bits >= DOUBT * n and x.r <= CHANCE}


def _repeats(df: DataFrame, combo: tuple[str, ...]) -> bool:
    """Whether two rows agree in a combination; null agrees with null."""
    return not df.groupBy(*[F.col(f"`{c}`") for c in combo]).count().where("count > 1").isEmpty()


def _repeating(df: DataFrame, combos: list[tuple[str, ...]], n: int) -> set[tuple[str, ...]]:
    """Which combinations repeat, from the hashes of all rows in one pass: a combination without equal hashes is a key.

    Hashes travel sorted and packed, and meet by ranges of ``SHARE`` at most, unless values repeat. Where more of them are equal than chance
    allows, values are; a few equal ones are looked into. What repeats that often among the rows of one task alone sends no more than that.
    Texts with a collation may be equal without equal hashes, so they are grouped by themselves.
    """
    collated = {f.name for f in df.schema if "collate" in f.dataType.simpleString()}
    apart = {c for c in combos if not collated.isdisjoint(c)}
    again = {c for c in combos if c in apart and _repeats(df, c)}
    if not (combos := [c for c in combos if c not in apart]):
        return again
    chance = CHANCE + (n * n >> 60)
    bounds = np.array([((j << 64) // parts) for parts in [-(-n // SHARE)] for j in range(1, parts)], np.uint64)
    hashed, each = _hashes(df, combos)

    def packed(batches):
        gone: set[int] = set()

        def flush(held):
            for i, h in each([np.concatenate(c) for c in zip(*held)]):
                if i in gone:
                    continue
                h = np.sort(h)
                twice = h[1:][h[1:] == h[:-1]]
                if len(twice) > chance:
                    gone.add(i)
                    h = np.repeat(twice[: chance + 1], 2)
                ends = [0, *np.searchsorted(h, bounds), len(h)]
                some = [p for p in range(len(bounds) + 1) if ends[p] < ends[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([i] * len(some), pa.int32()), pa.array([h[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary())], ["p", "i", "h"])

        held, rows = [], 0
        for b in batches:
            held.append([c.to_numpy().view(np.uint64) for c in b.columns])
            if (rows := rows + b.num_rows) >= ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    def equal(group):
        h = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in group["h"].to_pylist()]))
        return pa.table([group["i"][:1], pa.array([np.count_nonzero(h[1:] == h[:-1])], pa.int64())], ["i", "r"])

    met = hashed.mapInArrow(packed, "p int, i int, h binary").groupBy("p", "i").applyInArrow(equal, "i int, r long")
    found = {combos[x.i]: x.r for x in met.groupBy("i").agg(F.sum("r").alias("r")).where("r > 0").collect()}
    return again | {c for c, r in found.items() if r > chance or _repeats(df, c)}


def find_keys(df: DataFrame, columns: list[str] | None = None, max_size: int = 3) -> DataFrame:
    """(key, n_columns): every minimal key of up to ``max_size`` of the ``columns`` (by default all), its columns in the order given, comma-joined.

    The search goes up by size. What holds a key is no minimal key; what lies in a combination that repeats is no key at all: if
    all columns but one repeat, that one is in every key. Combinations of which a sample of values repeats drop out without a
    shuffle of the rows; the few left are decided by all rows, those of a size together. An empty table has the empty key only, and
    gives no rows.
    """
    columns = [c for c in dict.fromkeys(df.columns if columns is None else columns) if c in df.columns]
    spark, n = df.sparkSession, df.count()
    keys: list[tuple[str, ...]] = []
    if n and columns:
        whole = tuple(columns)
        without = {c: tuple(x for x in columns if x != c) for c in columns}
        sizes = range(1, min(max_size, len(columns)) + 1)
        sampled = {whole, *filter(None, without.values())}
        if sum(comb(len(columns), size) for size in sizes) <= TOGETHER:
            sampled |= {c for size in sizes for c in combinations(columns, size)}
        out = _ruled_out(df, sorted(sampled), n)
        needed = {c for c, w in without.items() if (not w and n > 1) or w in out}
        sure = False
        for size in sizes if whole not in out else ():
            open_ = [c for c in combinations(columns, size) if needed <= {*c} and not any({*k} <= {*c} for k in keys)]
            if more := [c for c in open_ if c not in sampled]:
                out |= _ruled_out(df, more, n)
            if left := [c for c in open_ if c not in out]:
                again = _repeating(df, left if sure or whole in left else [*left, whole], n)
                if whole in again:
                    break
                sure = True
                keys += [c for c in left if c not in again]
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys], "key string, n_columns int")
