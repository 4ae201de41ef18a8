"""Checks of captured responses: filters, paging and empty lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_violations(rows: DataFrame, predicate: Column) -> DataFrame:
    """Captured rows that break the filter they were requested with; unknown counts as broken."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def for_interface(df: DataFrame, name: str, scope_col: str = "scope") -> DataFrame:
    """Rows of one interface: by its name, or where their scope list or text names it."""
    kind = df.schema[scope_col].dataType.typeName()
    scope = F.array_contains(scope_col, name) if kind == "array" else F.array_contains(F.split(scope_col, r"\s*[,;]\s*"), name)
    return df.where((F.col("interface_name") == name) | F.coalesce(scope, F.lit(False)))


def paging_check(page_rows: DataFrame, expected: DataFrame, key: str, again: DataFrame | None = None) -> DataFrame:
    """(key, finding): rows on several pages, rows that never came, rows that came unasked, and, given a second read, rows at another place."""
    seen = page_rows.groupBy(key).agg(F.count_distinct("page").alias("pages"))
    out = seen.where("pages > 1").select(key, F.lit("repeated").alias("finding"))
    out = out.union(expected.select(key).distinct().join(seen, key, "left_anti").select(key, F.lit("never_returned")))
    out = out.union(seen.join(expected, key, "left_anti").select(key, F.lit("unexpected")))
    if again is not None:
        place = lambda df, n: df.groupBy(key).agg(F.min(F.struct("page", "position")).alias(n))
        out = out.union(place(page_rows, "a").join(place(again, "b"), key).where("a <> b").select(key, F.lit("unstable_order")))
    return out


def check_empty_lists(requests: DataFrame, captured: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """``status`` of each request: PASS if both have rows or both none, FAIL if only the source has, WARN if only the answer has."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    full = requests.join(n(captured, "n_captured"), by, "left").join(n(source, "n_source"), by, "left").na.fill(0, ["n_captured", "n_source"])
    return full.withColumn("status", F.when((F.col("n_captured") == 0) & (F.col("n_source") > 0), "FAIL").when((F.col("n_captured") > 0) & (F.col("n_source") == 0), "WARN").otherwise("PASS"))
