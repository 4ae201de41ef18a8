"""Tables with planted differences, derived from the given ones by arithmetic on keys, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import FieldRule

ORDER_RULES = [FieldRule("status", category="status"), FieldRule("price", kind="decimal", scale=2, category="amount"), FieldRule("priority", category="business")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of few bytes dealt out over many tasks, where each row is much work or grows to many."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("string").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), price.alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("odate"))


def orders_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target with rows dropped, changed, doubled and added."""
    base, k = orders(spark, sf_dir), F.col("k")
    changed = base.where(k % 97 != 0).select("k", "cust", F.when(k % 61 == 0, F.lower("status")).otherwise(F.col("status")).alias("status"), F.when(k % 53 == 0, F.col("price") + F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("price")).cast("decimal(18,2)").alias("price"), F.when(k % 71 != 0, F.col("priority")).alias("priority"), "odate")
    doubled = base.where((k % 89 == 0) & (k % 97 != 0))
    added = base.where(k % 101 == 0).withColumn("k", -(k + 1))
    return changed.union(doubled).union(added)


ORDERS_SQL = """
    ob AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS price, o_orderpriority AS priority, o_orderdate AS odate FROM orders),
    oc AS (
        SELECT k, cust, CASE WHEN k % 61 = 0 THEN lower(status) ELSE status END AS status, CASE WHEN k % 53 = 0 THEN CAST(price + 0.01 AS DECIMAL(18,2)) ELSE price END AS price, CASE WHEN k % 71 <> 0 THEN priority END AS priority, odate FROM ob WHERE k % 97 <> 0
        UNION ALL SELECT * FROM ob WHERE k % 89 = 0 AND k % 97 <> 0
        UNION ALL SELECT -(k + 1), cust, status, price, priority, odate FROM ob WHERE k % 101 = 0
    )"""

#: One row for each key that stands once on both sides.
MATCHED_SQL = ORDERS_SQL + """,
    once AS (SELECT k FROM oc GROUP BY k HAVING count(*) = 1),
    m AS (SELECT s.k, s.status AS s1, t.status AS t1, s.price AS s2, t.price AS t2, s.priority AS s3, t.priority AS t3 FROM ob s JOIN oc t ON s.k = t.k JOIN once ON once.k = s.k)"""

#: Every difference of the orders and their copy: kind, key, field and both values as text.
DIFFS_SQL = MATCHED_SQL + """,
    tn AS (SELECT k, count(*) AS n FROM oc GROUP BY k),
    d AS (
        SELECT 'ORDER_TARGET_MISSING' AS diff_type, k AS key, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM ob WHERE k NOT IN (SELECT k FROM oc)
        UNION ALL SELECT 'ORDER_TARGET_EXTRA', k, NULL, NULL, NULL FROM tn WHERE k NOT IN (SELECT k FROM ob)
        UNION ALL SELECT 'ORDER_TARGET_DUPLICATE', k, NULL, NULL, NULL FROM tn WHERE n > 1 AND k IN (SELECT k FROM ob)
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', k, 'status', s1, t1 FROM m WHERE s1 IS DISTINCT FROM t1
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', k, 'price', CAST(s2 AS VARCHAR), CAST(t2 AS VARCHAR) FROM m WHERE s2 IS DISTINCT FROM t2
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', k, 'priority', s3, t3 FROM m WHERE s3 IS DISTINCT FROM t3
    )"""


def orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc): a JSON document for each order with its lines; some are broken, no object, without a key or with a wrong array."""
    o, k = orders(spark, sf_dir), F.col("k")
    lines = lineitem(spark, sf_dir).groupBy("lk").agg(F.sort_array(F.collect_list(F.struct(F.col("ln").alias("line"), F.col("part").alias("part"), F.col("qty").cast("string").alias("qty"), F.col("ext").cast("string").alias("ext")))).alias("details"))
    full = o.join(lines, o.k == lines.lk, "left")
    number, status, price = F.when(k % 227 != 0, k).alias("orderNo"), F.col("status"), F.col("price").cast("string").alias("price")
    whole = F.to_json(F.struct(number, status, price, F.coalesce("details", F.array().cast(lines.schema["details"].dataType)).alias("details")))
    wrong = F.to_json(F.struct(number, status, price, F.lit("x").alias("details")))
    doc = F.when(k % 211 == 0, "bad{").when(k % 223 == 0, "[1]").when(k % 229 == 0, wrong).otherwise(whole)
    return full.select(F.col("k").alias("id"), doc.alias("doc"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = lambda c: F.col(c).cast("string").cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lk"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"), amount("l_quantity").alias("qty"), amount("l_extendedprice").alias("ext"))


def lineitem_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without line 7 of every 43rd order, and with another amount in every 59th order's line 1."""
    rows = lineitem(spark, sf_dir).where(~((F.col("ln") == 7) & (F.col("lk") % 43 == 0)))
    return rows.withColumn("ext", F.when((F.col("ln") == 1) & (F.col("lk") % 59 == 0), F.col("ext") + 1).otherwise(F.col("ext")).cast("decimal(18,2)"))


LINES_SQL = """
    li AS (SELECT l_orderkey AS lk, l_linenumber AS ln, l_partkey AS part, CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(18,2)) AS qty, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18,2)) AS ext FROM lineitem),
    lc AS (SELECT lk, ln, part, qty, CASE WHEN ln = 1 AND lk % 59 = 0 THEN CAST(ext + 1 AS DECIMAL(18,2)) ELSE ext END AS ext FROM li WHERE NOT (ln = 7 AND lk % 43 = 0))"""
