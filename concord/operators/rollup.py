"""Test and verification results rolled up to suites, interfaces and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import norm_status

CASE_STATUSES = ("passed", "failed", "blocked", "warning", "skipped", "unknown")
#: Verification statuses, worst first.
VERDICTS = ("FAIL", "BLOCKED", "WARN", "PASS")


def normalize_cases(cases: DataFrame, flip: bool = True) -> DataFrame:
    """Defaults for id and title, a known status, assertion counts (declared if given, else counted); with ``flip`` a passed case with a failed assertion fails."""
    named = cases.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("CASE-"), F.col("ordinal")))).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "id"))
    total, passed = assertion_counts(cases)
    broken = F.coalesce(F.exists("assertions", lambda a: ~F.coalesce(a["passed"], F.lit(False))), F.lit(False))
    status = norm_status(F.col("status"))
    if flip:
        status = F.when((status == "passed") & broken, "failed").otherwise(status)
    return named.withColumns({"status": status, "n_assertions": total, "n_passed_assertions": passed, "n_screenshots": F.coalesce(F.size("screenshots"), F.lit(0)) if "screenshots" in cases.columns else F.lit(0)})


def assertion_counts(cases: DataFrame) -> tuple[Column, Column]:
    """(assertions, passed ones) of a case: the declared number where it is one, else those listed."""
    listed = F.coalesce(F.when(F.col("assertions").isNotNull(), F.size("assertions")), F.lit(0))
    declared = F.col("declared_assertions").try_cast("int") if "declared_assertions" in cases.columns else F.lit(None).cast("int")
    passed = F.coalesce(F.when(F.col("assertions").isNotNull(), F.size(F.filter("assertions", lambda a: F.coalesce(a["passed"], F.lit(False))))), F.lit(0))
    return F.coalesce(declared, listed).cast("int"), passed


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in CASE_STATUSES]


def _sums() -> list[Column]:
    """Assertions, those that passed or not, and screenshots."""
    return [F.sum("n_assertions").alias("assertions"), F.sum("n_passed_assertions").alias("passed_assertions"), F.sum(F.greatest(F.col("n_assertions") - F.col("n_passed_assertions"), F.lit(0))).alias("failed_assertions"), F.sum("n_screenshots").alias("screenshots")]


def _rate(df: DataFrame) -> DataFrame:
    return df.withColumn("pass_rate", F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 2)).otherwise(0.0))


def suite_summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Case, status and assertion counts with the pass rate of each group."""
    return _rate(cases.groupBy(*by).agg(F.count("*").alias("total"), *_status_counts(), *_sums()))


def total_summary(cases: DataFrame, levels: list[str]) -> DataFrame:
    """The same for every level from the whole down, by rollup; null stands for all."""
    return _rate(cases.rollup(*levels).agg(F.count("*").alias("total"), *_status_counts(), *_sums()))


def aggregate_status(cases: DataFrame, by: list[str]) -> DataFrame:
    """failed > blocked > all passed > skipped > unknown."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return cases.groupBy(*by).agg(F.when(any_("failed"), "failed").when(any_("blocked"), "blocked").when(F.bool_and(F.col("status") == "passed"), "passed").when(any_("skipped"), "skipped").otherwise("unknown").alias("status"))


def conclusion(summary: DataFrame) -> DataFrame:
    return summary.withColumn("conclusion", F.when(F.col("failed") > 0, "failed").when(F.col("blocked") > 0, "blocked").when((F.col("warning") > 0) | (F.col("skipped") > 0), "pass_with_risk").otherwise("pass"))


def core_summary(cases: DataFrame, prefixes: list[str], by: list[str]) -> DataFrame:
    """Statistics of the cases whose id starts with a core prefix; auxiliary ones do not dilute them."""
    return suite_summary(cases.where(F.col("id").rlike("^(" + "|".join(prefixes) + ")")), by)


def execution_matrix(cases: DataFrame, matrix: DataFrame) -> DataFrame:
    """(point_id, title, n_cases, status): cases exploded by the planning ids they relate to (their own where none), joined to the plan. Plan rows without cases are dropped, cases without a plan row kept."""
    ids = F.when(F.size("related_cases") > 0, F.col("related_cases")).otherwise(F.array("id"))
    linked = cases.select(F.explode(F.array_distinct(ids)).alias("point_id"), "status", F.col("id").alias("case_id"))
    per = linked.groupBy("point_id").agg(F.count_distinct("case_id").alias("n_cases"))
    return per.join(aggregate_status(linked, ["point_id"]), "point_id").join(matrix.select("point_id", "title"), "point_id", "left")


def attach_defects(matrix: DataFrame, defects: DataFrame) -> DataFrame:
    """``n_defects`` of each plan row, by the cases that defects relate to."""
    n = defects.select(F.explode("related_cases").alias("point_id"), "defect_id").groupBy("point_id").agg(F.count_distinct("defect_id").alias("n_defects"))
    return matrix.join(n, "point_id", "left").withColumn("n_defects", F.coalesce("n_defects", F.lit(0)))


def _rank(status: Column) -> Column:
    return F.when(status == "FAIL", 0).when(status == "BLOCKED", 1).when(status == "WARN", 2).when(status == "PASS", 3).otherwise(4)


def _name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in VERDICTS]), rank), F.lit("UNKNOWN"))


def worst_status(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(_name(F.min(_rank(F.col("status")))).alias("status"))


def overall(items: DataFrame) -> DataFrame:
    """(status, status3, n): the worst of all, and the view in which a warning passes."""
    out = items.agg(_name(F.min(_rank(F.col("status")))).alias("status"), F.count("*").alias("n"))
    return out.withColumn("status3", F.when(F.col("status").isin("WARN", "UNKNOWN"), "PASS").otherwise(F.col("status")))


def field_counts(rules: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Per interface: distinct fields, rules, validated fields, and those FAIL, BLOCKED and N/A; without accuracy rows the fields of the rules count."""
    r = rules.groupBy("interface_name").agg(F.count("*").alias("fields_with_rules"), F.count_distinct("target_field").alias("_ruled"))
    a = accuracy.groupBy("interface_name").agg(F.count_distinct("target_field").alias("_seen"), F.count("*").alias("fields_validated"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("FAIL", "fail_fields"), ("BLOCKED", "blocked_fields"), ("N/A", "na_fields"))])
    both = r.join(a, "interface_name", "full_outer").na.fill(0)
    return both.select("interface_name", F.when(F.col("_seen") > 0, F.col("_seen")).otherwise(F.col("_ruled")).alias("field_total"), "fields_with_rules", "fields_validated", "fail_fields", "blocked_fields", "na_fields")


def interface_names(*frames: DataFrame) -> DataFrame:
    names = [df.select(F.coalesce(*[F.nullif(c, F.lit("")) for c in ("interface_name", "interface_path") if c in df.columns]).alias("interface_name")) for df in frames]
    return reduce(DataFrame.union, names).where("interface_name is not null").distinct()


def interface_status(inventory: DataFrame, accuracy: DataFrame, gaps: DataFrame, samples: DataFrame) -> DataFrame:
    """Each interface's counts, the status they give (FAIL > BLOCKED > WARN, which any difference sample raises > PASS) and its declared one, if any."""
    acc = accuracy.groupBy("interface_name").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("FAIL", "BLOCKED", "WARN", "PASS")])
    n = lambda df, name: df.groupBy("interface_name").agg(F.count("*").alias(name))
    full = inventory.select("interface_name", "declared").join(acc, "interface_name", "left").join(n(gaps, "n_gaps"), "interface_name", "left").join(n(samples, "n_differences"), "interface_name", "left").na.fill(0, ["n_fail", "n_blocked", "n_warn", "n_pass", "n_gaps", "n_differences"])
    computed = F.when(F.col("n_fail") > 0, "FAIL").when((F.col("n_blocked") > 0) | (F.col("n_gaps") > 0), "BLOCKED").when((F.col("n_warn") > 0) | (F.col("n_differences") > 0), "WARN").when(F.col("n_pass") > 0, "PASS").otherwise("UNKNOWN")
    return full.withColumn("computed", computed).withColumn("status", F.coalesce("declared", "computed"))


def batch_summary(batches: DataFrame, by: list[str]) -> DataFrame:
    """Batches, counts by status, rows in total, done and failed, and the execution window, open where a batch has no end."""
    return batches.groupBy(*by).agg(F.count("*").alias("n_batches"), F.count_if(F.col("status") == "success").alias("n_success"), F.sum("total_count").alias("total_count"), F.sum("failed_count").alias("failed_count"), F.date_format(F.min("start_time"), "yyyy-MM-dd HH:mm:ss").alias("first_start"), F.when(F.bool_or(F.col("end_time").isNull()), "open").otherwise(F.date_format(F.max("end_time"), "yyyy-MM-dd HH:mm:ss")).alias("last_end"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def accuracy_for_fields(fields: DataFrame, accuracy: DataFrame) -> DataFrame:
    """The accuracy record of each field: one of exactly its name, else one whose grouped text names it; the worst status wins."""
    exact = fields.join(accuracy.select(F.col("target_field").alias("field_name"), F.col("target_field").alias("record"), "status"), "field_name").withColumn("exactness", F.lit(0))
    parts = accuracy.select(F.explode(F.split("target_field", r"[,/、\s]+")).alias("field_name"), F.col("target_field").alias("record"), "status").where(F.col("field_name") != F.col("record"))
    loose = fields.join(parts, "field_name").withColumn("exactness", F.lit(1))
    rank = Window.partitionBy("field_name").orderBy("exactness", _rank(F.col("status")), "record")
    best = exact.unionByName(loose).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
    return fields.join(best, "field_name", "left")


def samples_for_fields(fields: DataFrame, samples: DataFrame) -> DataFrame:
    """(field_name, business_key) of the difference samples whose field text names the field."""
    parts = samples.select("business_key", F.explode(F.array_distinct(F.split("difference_field", r"[,/、\s]+"))).alias("field_name"))
    return fields.join(parts, "field_name")


def rule_targets(rules: DataFrame, default_table: str, helpers: list[str] = ()) -> DataFrame:
    """(rule_id, target_table, target_column) from texts such as ``orders.status, price``; helper tables are dropped."""
    parts = rules.select("rule_id", F.explode(F.split("target_text", r"\s*[,;、]\s*")).alias("x")).where("x <> ''")
    named = parts.select("rule_id", F.when(F.col("x").contains("."), F.regexp_extract("x", r"^([^.]+)\.", 1)).otherwise(default_table).alias("target_table"), F.regexp_extract("x", r"([^.]+)$", 1).alias("target_column"))
    return named.where(~F.col("target_table").isin(*helpers)).distinct() if helpers else named.distinct()


def target_sources(rules: DataFrame, hints: DataFrame, source_fields: DataFrame, most: int = 10_000) -> DataFrame:
    """(target_field, source_field, origin): a field's declared sources, else hinted ones, else all fields of the source, at most ``most``, which are broadcast."""
    if source_fields.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} source fields")
    own = rules.select("target_field", F.explode(F.split("source_text", r"\s*,\s*")).alias("source_field"), F.lit("rule").alias("origin")).where("source_field <> ''")
    open_ = rules.select("target_field").distinct().join(own, "target_field", "left_anti")
    hinted = open_.join(hints.select("target_field", "source_field"), "target_field").withColumn("origin", F.lit("hint"))
    rest = open_.join(hints, "target_field", "left_anti").join(F.broadcast(source_fields.select("source_field"))).withColumn("origin", F.lit("all"))
    return own.unionByName(hinted).unionByName(rest)


def resolve_names(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """``display_name`` of each row's interface, by name, else by path; the first in the inventory's order where several fit."""
    first = lambda key: inventory.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("display_name", "ordinal").alias(f"_by_{key}"))
    joined = df.join(first("interface_name"), "interface_name", "left").join(first("interface_path"), "interface_path", "left")
    return joined.withColumn("display_name", F.coalesce("_by_interface_name", "_by_interface_path", "interface_name")).drop("_by_interface_name", "_by_interface_path")


def resolve_fields(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``field_alias`` of each row's ``field_name``: the first alias that ``rules(interface_name, field_name, alias, ordinal)`` give it in its interface, else in any."""
    known = rules.where(F.coalesce(F.trim("alias"), F.lit("")) != "")
    here = known.groupBy("interface_name", "field_name").agg(F.min_by("alias", "ordinal").alias("_here"))
    any_ = known.groupBy("field_name").agg(F.min_by("alias", "ordinal").alias("_any"))
    joined = df.join(here, ["interface_name", "field_name"], "left").join(any_, "field_name", "left")
    return joined.withColumn("field_alias", F.coalesce("_here", "_any", "field_name")).drop("_here", "_any")


def interface_reasons(*frames: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` distinct reasons of each interface, by ``ordinal``."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("interface_name", "reason", "ordinal") for df in frames])
    once = rows.groupBy("interface_name", "reason").agg(F.min("ordinal").alias("ordinal"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("interface_name").orderBy("ordinal", "reason"))).where(F.col("place") <= k).select("interface_name", "place", "reason")
