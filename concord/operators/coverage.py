"""Which fields are mapped, collected, written and verified; which dimensions were not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flagged(*parts: tuple[DataFrame, str], by: list[str]) -> DataFrame:
    """One row for each key with a flag for each frame that holds it."""
    rows = None
    for df, name in parts:
        one = df.select(*by, F.lit(name).alias("_part"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy(*by).agg(*[F.bool_or(F.col("_part") == name).alias(name) for _, name in parts])


def field_baseline(inventory: DataFrame) -> DataFrame:
    """(interface_name, field_name, finding) from ``inventory(interface_name, field_name, origin)``.

    Origins: documented, live, schema, legacy. live_extra: live but not documented; schema_only: in the schema, nowhere live or
    documented; schema_missing: live or documented, not in the schema; sample_not_covered: documented and in the schema, not live;
    baseline_blocked: legacy only; else aligned.
    """
    has = lambda o: F.bool_or(F.col("origin") == o).alias(o)
    flags = inventory.groupBy("interface_name", "field_name").agg(has("documented"), has("live"), has("schema"), has("legacy"))
    d, live, s = F.col("documented"), F.col("live"), F.col("schema")
    finding = F.when(~d & ~live & ~s, "baseline_blocked").when(live & ~d, "live_extra").when(s & ~live & ~d, "schema_only").when((live | d) & ~s, "schema_missing").when(d & s & ~live, "sample_not_covered").otherwise("aligned")
    return flags.select("interface_name", "field_name", finding.alias("finding"))


def field_rule_coverage(fields: DataFrame, rules: DataFrame, na: DataFrame, uncollected: DataFrame) -> DataFrame:
    """(interface_name, field_name, class): mapped, not_applicable, uncollected or unmapped, for each source field."""
    by = ["interface_name", "field_name"]
    flags = _flagged((fields, "known"), (rules, "mapped"), (na, "na"), (uncollected, "open"), by=by).where("known")
    kind = F.when(F.col("mapped"), "mapped").when(F.col("na"), "not_applicable").when(F.col("open"), "uncollected").otherwise("unmapped")
    return flags.select(*by, kind.alias("class"))


def coverage_gate(classes: DataFrame) -> DataFrame:
    """(interface_name, total, mapped, not_applicable, uncollected, unmapped, gate); the gate passes without unmapped fields."""
    counts = [F.count_if(F.col("class") == c).alias(c) for c in ("mapped", "not_applicable", "uncollected", "unmapped")]
    out = classes.groupBy("interface_name").agg(F.count("*").alias("total"), *counts)
    return out.withColumn("gate", F.when(F.col("unmapped") == 0, "PASS").otherwise("FAIL"))


def not_persisted(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """Source fields that no target holds."""
    by = [c for c in ("interface_name", "field_name") if c in fields.columns and c in targets.columns]
    return fields.join(targets, by, "left_anti")


def field_coverage(source_fields: DataFrame, rules: DataFrame, profile: DataFrame) -> DataFrame:
    """(field_name, class) from names of the source, rule targets, and ``profile(field, label)`` of the target's columns.

    mapped; mapped_not_written (the target holds nothing but null, empty, zero or default values); only_in_map; without_source_<label>.
    """
    names = _flagged((source_fields.select("field_name"), "src"), (rules.select("field_name"), "rule"), (profile.select(F.col("field").alias("field_name")), "tgt"), by=["field_name"])
    full = names.join(profile.select(F.col("field").alias("field_name"), "label"), "field_name", "left")
    kind = F.when(F.col("rule") & F.col("src") & (F.col("label") == "business"), "mapped").when(F.col("rule") & F.col("src"), "mapped_not_written").when(F.col("rule"), "only_in_map").when(F.col("tgt") & ~F.col("src"), F.concat(F.lit("without_source_"), F.col("label"))).otherwise("unmapped")
    return full.select("field_name", kind.alias("class"))


def coverage_gaps(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Expected checks that were not done, as rows; a check done with zero differences is not a gap."""
    return expected.join(done, "check_name", "left_anti").select("check_name", F.lit("NOT_VERIFIED").alias("status"))


def rule_consistency(rules: DataFrame) -> DataFrame:
    """``status`` from ``expected_rule`` and ``used_rule``: PASS if equal, BLOCKED if none was used, else WARN."""
    e, u = F.col("expected_rule"), F.col("used_rule")
    return rules.withColumn("status", F.when(u.isNull(), "BLOCKED").when(e.eqNullSafe(u), "PASS").otherwise("WARN"))
