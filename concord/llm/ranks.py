"""Ranks over all rows of a table, and whole numbers that stand for documents in the order of their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest_of, materialise


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the rank from 0 within ``group`` (not null) by ``order``, nulls first, and ``total``, the rows of the group.

    Rows are dealt out by range, so that a group of any size spreads over tasks. A row's rank is its place in its range plus what the
    group has in earlier ranges; of those there is one number a range and group. Rows that tie in ``order`` get some order for good.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_row", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_range", F.shiftright("_row", 33)), "ranked")
    parts = ranged.groupBy(group, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(group, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    return ranged.join(starts, [group, "_range"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): ``docs`` as (``doc``, ``key``, ``text``) with ``doc`` a struct of all columns but the text, and the different documents as (``key``, ``text``).

    ``key`` is a long that sorts as the ids do. Whole ids that are neither null nor repeated are their own keys, and nothing moves.
    Otherwise documents are ranked by id (null first), then by the digest of their text; rows equal in both are one document.
    """
    text = F.col(f"`{text_col}`").cast("binary").alias("text")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc")
    ident = F.col(f"`{id_col}`")
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        n, named = docs.agg(F.count("*"), F.count(ident)).first()
        if n == named and docs.groupBy(ident.alias("i")).count().where("count > 1").isEmpty():
            rows = docs.select(rest, ident.cast("long").alias("key"), text)
            return rows, rows.select("key", "text")
    ids = docs.select(ident.alias("i"), digest_of(text_col).alias("d")).distinct().withColumn("g", F.lit(0))
    keys = materialise(positions(ids, "g", ["i", "d"]).select("i", "d", F.col("pos").alias("key")), "keys")
    wide = docs.select(rest, ident.alias("_i"), digest_of(text_col).alias("_d"), text)
    rows = wide.join(keys, F.col("_i").eqNullSafe(F.col("i")) & (F.col("_d") == F.col("d"))).select("doc", "key", "text")
    return rows, rows.select("key", "text").dropDuplicates(["key"])
