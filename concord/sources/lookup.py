"""Reading of a target what the source's keys point to, and no more: keys become predicates that the target's store applies itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys of these types are compressed to ranges; of others, a text's order in a database may be another than Spark's.
ORDERED = ("byte", "short", "integer", "long", "date", "timestamp")


@dataclass(frozen=True)
class KeyPredicates:
    """SQL predicates on one column that together hold every key, and each key in one of them at most. ``exact``: nothing but keys."""

    column: str
    predicates: tuple[str, ...]
    exact: bool


def _literal(value) -> str:
    if isinstance(value, (int, float)):
        return str(value)
    text = str(value).replace("'", "''")
    return {"date": f"DATE '{text}'", "datetime": f"TIMESTAMP '{text}'"}.get(type(value).__name__, f"'{text}'")


def key_predicates(keys: DataFrame, column: str, max_keys: int = 10_000, batch: int = 500, ranges: int = 256) -> KeyPredicates | None:
    """The different keys of ``keys`` (its only column, nulls left out) as predicates on the target's ``column``.

    Up to ``max_keys`` keys are listed, ``batch`` in a predicate. More of them become at most ``ranges`` ranges, cut at the widest gaps
    between neighbouring keys: what the driver sees is bounded, and keys that lie close together, as those of a day's load do, leave
    the rest of the target unread. None for more keys of a type without a common order.
    """
    name = keys.columns[0]
    found = keys.select(F.col(f"`{name}`").alias("k")).where("k is not null").distinct()
    few = found.limit(max_keys + 1).collect()
    if len(few) <= max_keys:
        values = sorted(r.k for r in few)
        lists = [values[i : i + batch] for i in range(0, len(values), batch)]
        return KeyPredicates(column, tuple(f"{column} IN ({', '.join(map(_literal, v))})" for v in lists), True)
    kind = found.schema["k"].dataType.typeName()
    if kind not in ORDERED:
        return None
    # Neighbours are found in ranges of their own; between ranges there is one gap each.
    place = F.col("k").cast("long") if kind in ORDERED[:4] else F.unix_timestamp("k") if kind == "timestamp" else F.unix_date("k").cast("long")
    dealt = found.repartitionByRange("k").withColumn("p", F.spark_partition_id()).withColumn("place", place)
    ahead = F.lag(F.struct("k", "place")).over(Window.partitionBy("p").orderBy("k"))
    gaps = dealt.withColumn("a", ahead).where("a is not null").select(F.col("a.k").alias("end"), F.col("k").alias("start"), (F.col("place") - F.col("a.place")).alias("gap")).where("gap > 1")
    widest = gaps.orderBy(F.desc("gap"), "start").limit(ranges - 1).collect()
    low, high = found.agg(F.min("k"), F.max("k")).first()
    cuts = sorted(widest, key=lambda r: r.start)
    bounds = list(zip([low, *[r.start for r in cuts]], [*[r.end for r in cuts], high]))
    return KeyPredicates(column, tuple(f"({column} >= {_literal(a)} AND {column} <= {_literal(b)})" for a, b in bounds), False)


def rows_of_keys(target: DataFrame, keys: DataFrame, column: str, **how) -> DataFrame:
    """The rows of ``target`` whose ``column`` is a key. Files are filtered by the predicates as they are read, so parts without a key are skipped."""
    wanted = key_predicates(keys, column, **how)
    if wanted is not None:
        target = target.where(" OR ".join(wanted.predicates) or "false")
        if wanted.exact:
            return target
    name = keys.columns[0]
    return target.join(keys.select(F.col(f"`{name}`").alias("_k")).distinct(), F.col(f"`{column}`") == F.col("_k"), "left_semi")


def fetch_by_keys(spark: SparkSession, options: dict, table: str, keys: DataFrame, column: str, per_task: int = 8, **how) -> DataFrame:
    """The rows that a database sends for the keys: one partition for each predicate or, of many small ones, a few in each.

    Rows of no key may be among them where the keys were compressed to ranges; ``rows_of_keys`` or a join leaves them out.
    """
    wanted = key_predicates(keys, column, **how)
    props = {k: str(v) for k, v in options.items() if k != "url"}
    if wanted is None:
        return spark.read.jdbc(options["url"], table, properties=props)
    lists = list(wanted.predicates) or ["1 = 0"]
    step = 1 if wanted.exact else per_task
    return spark.read.jdbc(options["url"], table, predicates=[" OR ".join(lists[i : i + step]) for i in range(0, len(lists), step)], properties=props)


def quantile_predicates(spark: SparkSession, options: dict, table: str, column: str, partitions: int) -> list[str]:
    """Predicates for a partitioned JDBC read with about as many rows in each, however the keys lie; null keys go with the first.

    The key column alone is read, in slices of equal width, for the quantiles.
    """
    reader = lambda **more: spark.read.format("jdbc").options(**options | more)
    low, high = reader(query=f"SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {table}").load().first()
    if low is None:
        return ["1 = 1"]
    slices = reader(dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()
    cuts = slices.select(F.percentile_approx(column, [i / partitions for i in range(1, partitions)], 10_000)).first()[0] if partitions > 1 else []
    edges = sorted({*cuts} - {low})
    if not edges:
        return ["1 = 1"]
    middle = [f"{column} >= {_literal(a)} AND {column} < {_literal(b)}" for a, b in zip(edges[:-1], edges[1:])]
    return [f"{column} < {_literal(edges[0])} OR {column} IS NULL", *middle, f"{column} >= {_literal(edges[-1])}"]


def read_by_quantiles(spark: SparkSession, options: dict, table: str, column: str, partitions: int = 64) -> DataFrame:
    props = {k: str(v) for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=quantile_predicates(spark, options, table, column, partitions), properties=props)
