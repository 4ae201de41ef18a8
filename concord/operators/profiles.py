"""Profiles that merge: one state a batch and column, kept as a table; any set of batches is profiled from its states alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a state tracks; up to three quarters of so many different ones the numbers of the frequent values are exact.
TRACKED = 4096


def profile_state(df: DataFrame, cols: list[str], by: list[str] = (), lg_k: int = 12) -> DataFrame:
    """(by, field, n_rows, n_null, n_empty, n_zero, distinct_sketch, top_sketch) of each batch, in one pass over the rows.

    Counts are exact; a sketch of 2 ** ``lg_k`` registers stands for the different values, another for the frequent ones.
    """
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        text = F.trim(F.col(f"`{c}`").cast("string"))
        aggs += [F.count_if(text.isNull()).alias(f"u{i}"), F.count_if(text == "").alias(f"e{i}"), F.count_if(text.try_cast("decimal(38,6)") == 0).alias(f"z{i}"), F.hll_sketch_agg(F.concat(F.lit("="), text), F.lit(lg_k)).alias(f"h{i}"), F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias(f"t{i}")]
    rows = [F.struct(F.lit(c).alias("field"), F.col("n").alias("n_rows"), F.col(f"u{i}").alias("n_null"), F.col(f"e{i}").alias("n_empty"), F.col(f"z{i}").alias("n_zero"), F.col(f"h{i}").alias("distinct_sketch"), F.col(f"t{i}").alias("top_sketch")) for i, c in enumerate(cols)]
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def union_states(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states)


def merge_profiles(states: DataFrame, by: list[str] = ("field",), k: int = 5, default_share: float = 0.3) -> DataFrame:
    """(by, n_rows, n_null, n_empty, n_zero, n_distinct, top, default_value, n_default, label) of the batches behind ``states``.

    ``n_distinct`` is an estimate; ``top`` lists the ``k`` most frequent values as ``value:count``. A value that is neither empty nor zero and
    has ``default_share`` of all rows, while others occur, counts as the column's default. label: all_null, all_empty, all_zero,
    constant, mixed (nothing but nulls, empty texts, zeros and the default) or business.
    """
    total = lambda c: F.sum(c).alias(c)
    merged = states.groupBy(*by).agg(total("n_rows"), total("n_null"), total("n_empty"), total("n_zero"), F.hll_union_agg("distinct_sketch").alias("_h"), F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(TRACKED)).alias("_t"))
    top = F.call_function("approx_top_k_estimate", F.col("_t"), F.lit(max(k, 8)))
    rows = merged.withColumns({"n_distinct": F.hll_sketch_estimate("_h"), "_top": F.array_sort(F.transform(top, lambda x: F.struct((-x["count"]).alias("r"), x["item"].alias("item"))))})
    plain = F.filter("_top", lambda x: x["item"].isNotNull() & (x["item"] != "") & ~F.coalesce(x["item"].try_cast("decimal(38,6)") == 0, F.lit(False)))
    rows = rows.withColumn("_first", F.get(plain, F.lit(0)))
    n, u, e, z = (F.col(c) for c in ("n_rows", "n_null", "n_empty", "n_zero"))
    usual = (-F.col("_first.r") >= default_share * n) & (F.col("n_distinct") > 1)
    rows = rows.withColumns({"default_value": F.when(usual, F.col("_first.item")), "n_default": F.when(usual, -F.col("_first.r")).otherwise(0).cast("long")})
    label = F.when(u == n, "all_null").when(e == n, "all_empty").when(z == n, "all_zero").when((F.col("n_distinct") == 1) & (u == 0), "constant").when(u + e + z + F.col("n_default") == n, "mixed").otherwise("business")
    shown = F.array_join(F.transform(F.slice("_top", 1, k), lambda x: F.concat_ws(":", F.coalesce(x["item"], F.lit("<NULL>")), -x["r"])), ";")
    return rows.select(*by, "n_rows", "n_null", "n_empty", "n_zero", "n_distinct", shown.alias("top"), "default_value", "n_default", label.alias("label"))
