"""Reconciling by digests: both sides are summed up by buckets of their keys, and only rows of buckets that differ are compared.

A bucket is a prefix of the hexadecimal md5 of a row's key, so buckets nest: a node of the tree is a prefix, and its digest the sum of
those of its sixteen children. A side's digests can be kept and compared again later without reading its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import FieldRule, canonical_key
from ..sources.shared import written
from .reconcile import _fields, key_names, reconcile

#: Buckets hold about so many rows.
ROWS = 16
#: What is known of a node: rows, two sums of 64-bit row digests, and whether a key may stand there twice or a row is at fault by itself.
NODE = ("n", "d1", "d2", "mark")


def bucket(keys: list[str], digits: int):
    """Column: the node of a row at the depth of ``digits``."""
    return F.substring(F.md5(canonical_key(*[F.col(f"`{k}`") for k in keys])), 1, digits)


def digests(df: DataFrame, keys: list[str], rules: list[FieldRule], digits: int, side: str = "source", json_col: str | None = None) -> DataFrame:
    """(node, n, d1, d2, mark): the leaves of one side's tree; fields count as the rules normalise them.

    Rows are added up by a 64-bit hash of their key first, so keys that repeat are seen; a source row that lacks a required field, or
    whose field cannot be read, marks its bucket, since it is a difference whatever the target holds.
    """
    rows = _fields(df, keys, rules, side, "f", json_col)
    names = key_names(keys)
    values = [F.col(f"f.f{i}").cast("string") for i in range(len(rules))]
    fault = F.lit(False)
    for i, r in enumerate(rules):
        fault = fault | F.col(f"f.e{i}") | (F.lit(r.required and side == "source") & r.blank(F.col(f"f.r{i}")))
    # A null and an empty value must not hash alike, nor values that move from one field to the next.
    image = F.struct(*[F.struct(v, v.isNull().alias("gone")) for v in values])
    own = F.struct(*[F.col(n).cast("string") for n in names])
    number = lambda seed: F.xxhash64(F.lit(seed), own, image).cast("decimal(20,0)")
    keyed = rows.select(bucket(names, digits).alias("node"), F.xxhash64(F.lit(0), own).alias("k"), number(1).alias("d1"), number(2).alias("d2"), F.coalesce(fault, F.lit(False)).alias("fault"))
    by_key = keyed.groupBy("node", "k").agg(F.count("*").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.bool_or("fault").alias("fault"))
    return by_key.groupBy("node").agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.bool_or(F.col("fault") | (F.col("n") > 1)).alias("mark"))


def lifted(nodes: DataFrame, digits: int) -> DataFrame:
    """The nodes of a higher level, at the depth of ``digits``."""
    return nodes.groupBy(F.substring("node", 1, digits).alias("node")).agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.bool_or("mark").alias("mark"))


def differing(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """(node): the leaves in which the two sides differ or that either marks. Levels are compared from the top; only children of nodes that differ are looked at."""
    open_: DataFrame | None = None
    for depth in range(1, digits + 1):
        left, right = (side if depth == digits else lifted(side, depth) for side in (a, b))
        if open_ is not None:
            parent = F.substring("node", 1, depth - 1) == F.col("_up")
            left, right = (side.join(open_.select(F.col("node").alias("_up")), parent, "left_semi") for side in (left, right))
        both = left.select("node", *[F.col(c).alias(f"l_{c}") for c in NODE]).join(right.select("node", *[F.col(c).alias(f"r_{c}") for c in NODE]), "node", "full_outer")
        same = F.lit(True)
        for c in ("n", "d1", "d2"):
            same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
        marked = F.coalesce("l_mark", F.lit(False)) | F.coalesce("r_mark", F.lit(False))
        open_ = written(both.where(~same | marked).select("node"), "nodes")
    return open_


@dataclass
class Reconciled:
    """``diffs``, as ``reconcile`` gives them; ``nodes``, the leaves that differ; ``source`` and ``target``, the rows that were read again."""

    diffs: DataFrame
    nodes: DataFrame
    source: DataFrame
    target: DataFrame

    def read_again(self) -> DataFrame:
        """(side, n_rows): the rows of the second pass."""
        return self.source.agg(F.lit("source").alias("side"), F.count("*").alias("n_rows")).union(self.target.agg(F.lit("target").alias("side"), F.count("*").alias("n_rows")))


def depth_for(n: int, rows: int = ROWS) -> int:
    """The digits that leave about ``rows`` of ``n`` rows in a bucket."""
    return max(1, math.ceil(math.log(max(n, 1) / rows, 16))) if n > rows else 1


def reconcile_by_digest(source: DataFrame, target: DataFrame, keys: list[str], rules: list[FieldRule], json_col: str | None = None, digits: int | None = None) -> Reconciled:
    """The same differences as ``reconcile``, by two passes. The first moves a hash of each row and one row a bucket; the second only the rows of buckets that differ.

    Keys must read alike as text on both sides. ``digits``: the depth of the tree, by default from the number of target rows. Worth it where few rows differ: with d differing
    rows, about ``ROWS`` d rows are compared in full.
    """
    digits = digits or depth_for(target.count())
    a = written(digests(source, keys, rules, digits, "source", json_col), "digests")
    b = written(digests(target, keys, rules, digits, "target"), "digests")
    nodes = differing(a, b, digits)
    some = lambda df: df.withColumns({"_node": bucket(keys, digits)}).join(nodes.withColumnRenamed("node", "_node"), "_node", "left_semi").drop("_node")
    left, right = some(source), some(target)
    return Reconciled(reconcile(left, right, keys, rules, json_col), nodes, left, right)
