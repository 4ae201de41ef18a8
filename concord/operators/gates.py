"""Quality gates over result tables: each check gives rows that break it, and a gate gives the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_required(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """(keep, column): required values that are null or blank."""
    blank = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(blank).alias("column"))


def check_enum(df: DataFrame, col: str, allowed: list[str], keep: list[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))).select(*keep, F.col(col).alias("value"))


def check_evidence(results: DataFrame, rules: DataFrame, accuracy: DataFrame, samples: DataFrame) -> DataFrame:
    """(interface_name, problem): PASS without rules or accuracy, BLOCKED without evidence, differences without a readable sample."""
    has = lambda df, n: df.select("interface_name").distinct().withColumn(n, F.lit(True))
    readable = samples.where(F.coalesce(F.trim("difference_note"), F.lit("")) != "")
    full = results.join(has(rules, "_rules"), "interface_name", "left").join(has(accuracy, "_accuracy"), "interface_name", "left").join(has(readable, "_samples"), "interface_name", "left")
    lacks = lambda n: F.col(n).isNull()
    problems = F.array(
        F.when((F.col("status") == "PASS") & lacks("_rules"), F.lit("pass_without_rules")),
        F.when((F.col("status") == "PASS") & lacks("_accuracy"), F.lit("pass_without_accuracy")),
        F.when((F.col("status") == "BLOCKED") & (F.coalesce(F.trim("evidence"), F.lit("")) == ""), F.lit("blocked_without_evidence")),
        F.when((F.col("n_differences") > 0) & lacks("_samples"), F.lit("differences_without_sample")),
    )
    return full.select("interface_name", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def check_counts(declared: DataFrame, computed: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(by, measure, declared, computed) where a declared count is not what the rows give."""
    both = declared.select(*by, *[F.col(m).alias(f"_d_{m}") for m in measures]).join(computed.select(*by, *[F.col(m).alias(f"_c_{m}") for m in measures]), by, "full_outer")
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_d_{m}").cast("long").alias("declared"), F.col(f"_c_{m}").cast("long").alias("computed")) for m in measures])
    return both.select(*by, F.inline(F.filter(rows, lambda x: ~x["declared"].eqNullSafe(x["computed"]))))


def check_cases(cases: DataFrame) -> DataFrame:
    """(id, problem): no title, an incomplete assertion, a passed case with a failed assertion, a failed case without screenshot."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda f: F.coalesce(F.exists("assertions", f), F.lit(False))
    problems = F.array(
        F.when(blank(F.col("title")), F.lit("no_title")),
        F.when(some(lambda a: blank(a["check"]) | blank(a["expected"]) | blank(a["actual"])), F.lit("incomplete_assertion")),
        F.when((F.col("status") == "passed") & some(lambda a: ~F.coalesce(a["passed"], F.lit(False))), F.lit("passed_with_failed_assertion")),
        F.when((F.col("status") == "failed") & (F.coalesce(F.size("screenshots"), F.lit(0)) <= 0), F.lit("failed_without_screenshot")),
    )
    return cases.select("id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def mapping_warnings(matrix: DataFrame, cases: DataFrame, least: int = 1) -> DataFrame:
    """(point_id, case_id, hits): linked cases whose title holds fewer than ``least`` of the plan row's key terms."""
    linked = cases.select(F.col("id").alias("case_id"), "title", F.explode("related_cases").alias("point_id"))
    hits = F.size(F.filter("terms", lambda t: F.lower("title").contains(F.lower(t))))
    return linked.join(matrix.select("point_id", "terms"), "point_id").withColumn("hits", hits).where(F.col("hits") < least).select("point_id", "case_id", "hits")


def gate(checks: DataFrame) -> DataFrame:
    """``status`` of each named check from ``value``, ``soft`` and ``hard`` limits, beside the gate's: FAIL > WARN > PASS."""
    status = F.when(F.col("value") > F.col("hard"), "FAIL").when(F.col("value") > F.col("soft"), "WARN").otherwise("PASS")
    rated = checks.withColumn("status", status)
    worst = rated.agg(F.min(F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)).alias("_w"))
    return rated.select("check_name", "value", "status").join(F.broadcast(worst.select(F.get(F.array(F.lit("FAIL"), F.lit("WARN"), F.lit("PASS")), F.col("_w")).alias("gate"))))
