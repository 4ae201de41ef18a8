"""Reconciling a source with a target: missing, extra, duplicate and differing rows, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import FieldRule, canonical_key, raw_table

#: Columns of every table of differences, with their types.
DIFF_SCHEMA = "diff_type string, scope string, category string, blocking boolean, source_id string, business_key string, detail_key string, detail_index int, json_path string, field string, expected string, actual string, expected_raw string, actual_raw string, n bigint, error string"
DIFF_COLUMNS = tuple(x.split()[0] for x in DIFF_SCHEMA.split(", "))

#: Kinds of differences by their meaning.
RELATIONSHIP_TYPES = ("ORPHAN_DETAIL", "SOURCE_BUSINESS_KEY_DUPLICATE", "ORDER_TARGET_DUPLICATE", "DETAIL_SOURCE_KEY_DUPLICATE", "DETAIL_TARGET_KEY_DUPLICATE")
BLOCKING_TYPES = ("SOURCE_JSON_INVALID", "SOURCE_JSON_NOT_OBJECT", "DETAIL_ARRAY_NOT_LIST", "DETAIL_FETCH_ERROR", "ORDER_SOURCE_KEY_ERROR", "DETAIL_SOURCE_KEY_ERROR", "DETAIL_TARGET_KEY_ERROR")
BLOCKING_ENDINGS = ("_TARGET_COLUMN_MISSING", "_REQUIRED_SOURCE_VALUE_MISSING", "_NORMALIZE_ERROR")


def scope(df: DataFrame, predicate) -> DataFrame:
    """The same predicate for both sides, before anything is counted."""
    return df.where(predicate)


def smoke(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` source rows by key, for a trial run."""
    return df.orderBy(*keys).limit(n)


def business_columns(columns: list[str], technical: list[str]) -> list[str]:
    drop = {c.lower() for c in technical}
    return [c for c in columns if c.lower() not in drop]


def check_conditional(df: DataFrame, rules: list[tuple[str, Column, Column]], keep: list[str]) -> DataFrame:
    """Rows that meet a rule's condition and not its consequence; the reverse is not implied."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)) & ~F.coalesce(k, F.lit(False)), F.lit(n)) for n, c, k in rules]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def match_target(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hits, outcome) of each source row: 0 hits missing, 1 comparable, more duplicate. The target is counted first, so copies multiply nothing."""
    hits = target.groupBy(*keys).agg(F.count("*").alias("hits"))
    found = source.select(*keys).join(hits, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return found.withColumn("outcome", F.when(F.col("hits") == 0, "missing").when(F.col("hits") == 1, "comparable").otherwise("duplicate"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join by keys of which null equals null; the keys stand once in the result."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys])
    joined = left.withColumn("_left", F.lit(True)).join(other, same, how)
    if how == "left_semi":
        return joined.select(*left.columns)
    own = [F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_right_{k}")).alias(k) for k in keys] if how in ("full_outer", "right") else [F.col(k) for k in keys]
    return joined.select(*own, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def _read(df: DataFrame, keys: list[str], rules: list[FieldRule], side: str, name: str, json_col: str | None = None) -> DataFrame:
    """The keys by ``key_names`` and ``name``, a struct of each rule's raw value r and whether the source lacks it, m: what travels to a join."""
    if side == "target":  # a column that the target lacks is reported as such; until then it is null
        df = df.withColumns({r.column: F.lit(None).cast("string") for r in rules if r.column not in df.columns})
    df = df.withColumns({n: F.col(f"`{k}`") for n, k in zip(key_names(keys), keys)})
    raws = raw_table(df, rules, side, json_col, keep=key_names(keys))
    col = lambda r, end: F.col(f"`{r.column}{end}`")
    return raws.select(*key_names(keys), F.struct(*[x for i, r in enumerate(rules) for x in (col(r, "__raw").alias(f"r{i}"), col(r, "__missing").alias(f"m{i}"))]).alias(name))


def _normal(rules: list[FieldRule], side: str, name: str) -> Column:
    """The struct of ``_read`` with each rule's normalised value f and error e; null where the struct is."""
    col = lambda x, i: F.col(f"{name}.{x}{i}")
    cells = [x for i, r in enumerate(rules) for x in (r.normal(col("r", i), side).alias(f"f{i}"), col("r", i).alias(f"r{i}"), r.error(col("r", i), side).alias(f"e{i}"), col("m", i).alias(f"m{i}"))]
    return F.when(F.col(name).isNotNull(), F.struct(*cells))


def _fields(df: DataFrame, keys: list[str], rules: list[FieldRule], side: str, name: str, json_col: str | None = None) -> DataFrame:
    """The keys by ``key_names`` and ``name``, a struct of each rule's normalised value f, raw value r, error e and whether the source lacks it, m."""
    return _read(df, keys, rules, side, name, json_col).withColumn(name, _normal(rules, side, name))


def key_names(keys: list[str]) -> list[str]:
    """The names of key columns in joined tables, so that no name of the caller's meets one of ours; these are reserved."""
    return [f"_concord_key{i}" for i in range(len(keys))]


def key_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Each key of either side by ``key_names`` with ``sn`` and ``tn``, its rows there; null where there is none. Null keys equal each other."""
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    named = lambda df, sn, tn: df.select(*[F.col(f"`{k}`").alias(n) for n, k in zip(key_names(keys), keys)], sn.alias("sn"), tn.alias("tn"))
    return named(source, one, none).union(named(target, none, one)).groupBy(*key_names(keys)).agg(F.sum("sn").alias("sn"), F.sum("tn").alias("tn"))


def matched_rows(source: DataFrame, target: DataFrame, keys: list[str], rules: list[FieldRule], json_col: str | None = None) -> DataFrame:
    """Every source row with the target of its key, and the keys that one side lacks: ``_concord_key0``.., ``sn``, ``tn`` rows of the key on either side, fields ``s``, ``t``.

    ``t`` is null where the target lacks the key or repeats it, so copies multiply nothing. Null keys equal each other. Source fields
    come from columns, from ``json_col``, or are constants and computed values, as the rules say; the target's are its columns.
    Only keys are aggregated, and raw values joined; they are normalised afterwards, so what a task sorts stays small.
    """
    own = _read(source, keys, rules, "source", "s", json_col)
    held = _read(target, keys, rules, "target", "t")
    counts, keys = key_counts(source, target, keys), key_names(keys)
    single = null_safe_join(held, counts.where("tn = 1").select(*keys), keys, "left_semi")
    joined = null_safe_join(null_safe_join(counts, own, keys, "left"), single, keys, "left")
    return joined.withColumns({"s": _normal(rules, "source", "s"), "t": _normal(rules, "target", "t")})


def field_cells(rules: list[FieldRule], prefix: str = "ORDER", target_columns: list[str] | None = None) -> list[Column]:
    """For each rule a struct of what is wrong with the field of ``s`` against ``t``; its diff_type is null where nothing is."""
    cells = []
    for i, r in enumerate(rules):
        s, t, rs, rt = F.col(f"s.f{i}"), F.col(f"t.f{i}"), F.col(f"s.r{i}"), F.col(f"t.r{i}")
        error = F.col(f"s.e{i}") | F.col(f"t.e{i}")
        skip = F.lit(r.ignore_if_source_missing) & F.col(f"s.m{i}")
        kind = F.when(F.lit(r.required) & r.blank(rs), f"{prefix}_REQUIRED_SOURCE_VALUE_MISSING")
        if target_columns is not None and r.column not in target_columns:
            kind = kind.otherwise(f"{prefix}_TARGET_COLUMN_MISSING")
        else:
            kind = kind.when(skip, None).when(error, f"{prefix}_NORMALIZE_ERROR").when(~s.eqNullSafe(t), f"{prefix}_FIELD_MISMATCH")
        what = F.when(error, F.concat(F.lit(f"not a {r.kind}: "), F.when(F.col(f"s.e{i}"), rs).otherwise(rt)))
        cells.append(F.struct(kind.alias("diff_type"), F.lit(r.origin).alias("json_path"), F.lit(r.column).alias("field"), s.alias("expected"), t.alias("actual"), rs.alias("expected_raw"), rt.alias("actual_raw"), what.alias("error")))
    return cells


def wrong_fields(cells: list[Column]) -> Column:
    return F.inline(F.filter(F.array(*cells), lambda x: x["diff_type"].isNotNull()))


def compare_fields(joined: DataFrame, keys: list[str], rules: list[FieldRule]) -> DataFrame:
    """A row for each field that differs, in one pass over the source rows whose key the target holds once."""
    key = canonical_key(*[F.col(k) for k in key_names(keys)]).alias("business_key")
    return joined.where("tn = 1 and s is not null").select(key, wrong_fields(field_cells(rules)))


def reconcile(source: DataFrame, target: DataFrame, keys: list[str], rules: list[FieldRule], json_col: str | None = None) -> DataFrame:
    """All differences: missing in target, extra in target, duplicates on either side, and differing fields.

    Each source row is compared with the one target row of its key, also where the source repeats the key; a key that the target
    repeats is not compared. Null keys equal each other.
    """
    joined = matched_rows(source, target, keys, rules, json_col)
    key = canonical_key(*[F.col(k) for k in key_names(keys)]).alias("business_key")
    kinds = F.filter(F.array(F.when(F.col("tn").isNull(), F.lit("ORDER_TARGET_MISSING")), F.when(F.col("sn").isNull(), F.lit("ORDER_TARGET_EXTRA")), F.when(F.col("sn") > 1, F.lit("SOURCE_BUSINESS_KEY_DUPLICATE")), F.when(F.col("sn").isNotNull() & (F.col("tn") > 1), F.lit("ORDER_TARGET_DUPLICATE"))), lambda x: x.isNotNull())
    rows = key_counts(source, target, keys).select(key, F.explode(kinds).alias("diff_type"), F.coalesce("tn", "sn").alias("n"))
    return union_diffs(rows, compare_fields(joined, keys, rules))


def union_diffs(*diffs: DataFrame) -> DataFrame:
    """The union of differences of any checks under the columns of ``DIFF_SCHEMA``, with scope, category and blocking of each kind."""
    types = dict(x.split() for x in DIFF_SCHEMA.split(", "))
    one = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    out = reduce(DataFrame.union, [one(df) for df in diffs])
    t = F.col("diff_type")
    scope = F.when(t.startswith("DETAIL_") | (t == "ORPHAN_DETAIL"), "detail").when(t.startswith("SOURCE_JSON"), "document").otherwise("order")
    return classify_diffs(out.withColumn("scope", scope)).select(*DIFF_COLUMNS)


def diff_counts(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("diff_type").agg(F.count("*").alias("n"))


def classify_diffs(diffs: DataFrame) -> DataFrame:
    """``category`` (relationship, source, order, detail, other) and ``blocking``."""
    t = F.col("diff_type")
    category = F.when(t.isin(*RELATIONSHIP_TYPES), "relationship").when(t.startswith("SOURCE_") | t.startswith("ORDER_SOURCE_KEY"), "source").when(t.startswith("ORDER_"), "order").when(t.startswith("DETAIL_"), "detail").otherwise("other")
    blocking = reduce(lambda a, b: a | b, [t.isin(*BLOCKING_TYPES), *[t.endswith(e) for e in BLOCKING_ENDINGS]])
    return diffs.withColumn("category", category).withColumn("blocking", blocking)


def totals(source: DataFrame, target: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    """(side, n_rows, n_keys)."""
    distinct = F.approx_count_distinct(F.struct(*keys)) if approximate else F.count_distinct(F.struct(*keys))
    one = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n_rows"), distinct.alias("n_keys"))
    return one(source, "source").union(one(target, "target"))


def key_uniqueness(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """(candidate, n_rows, n_distinct, is_unique) of each combination; null agrees with null.

    Combinations that hold one another are counted along one chain: the groups of the largest are grouped by the next, so rows are
    read once a chain and never multiplied.
    """
    chains: list[list[int]] = []
    for i in sorted(range(len(candidates)), key=lambda i: -len({*candidates[i]})):
        held = next((x for x in chains if {*candidates[i]} <= {*candidates[x[-1]]}), None)
        chains.append([i]) if held is None else held.append(i)
    out = []
    for chain in chains:
        rows = df.withColumn("_rows", F.lit(1).cast("long"))
        for at, i in enumerate(chain):
            within = [F.count("*").alias(f"_d{chain[at - 1]}")] if at else []
            rows = rows.groupBy(*candidates[i]).agg(F.sum("_rows").alias("_rows"), *[F.sum(f"_d{j}").alias(f"_d{j}") for j in chain[: max(at - 1, 0)]], *within)
        n, zero = F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"), F.lit(0)
        counts = rows.agg(n, *[F.coalesce(F.sum(f"_d{j}"), zero).alias(f"d{j}") for j in chain[:-1]], F.count("*").alias(f"d{chain[-1]}"))
        cells = [F.struct(F.lit(",".join(candidates[i])).alias("candidate"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), (F.col("n") == F.col(f"d{i}")).alias("is_unique")) for i in chain]
        out.append(counts.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.union, out)


def field_accuracy(joined: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """(target_field, category, checked_count, matched_count, mismatched_count, status) over one-to-one rows, all fields in one pass."""
    one = joined.where("sn = 1 and tn = 1")
    counts = one.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"s.f{i}").eqNullSafe(F.col(f"t.f{i}"))).alias(f"m{i}") for i in range(len(rules))])
    rows = F.array(*[F.struct(F.lit(r.column).alias("target_field"), F.lit(r.category).alias("category"), F.col("n").alias("checked_count"), F.col(f"m{i}").alias("matched_count"), (F.col("n") - F.col(f"m{i}")).alias("mismatched_count"), F.when(F.col("n") == F.col(f"m{i}"), "PASS").otherwise("WARN").alias("status")) for i, r in enumerate(rules)])
    return counts.select(F.inline(rows))


#: Categories in which a single mismatch fails.
ZERO_TOLERANCE = ("key", "status", "amount", "relation", "file", "critical_time")


def apply_zero_tolerance(accuracy: DataFrame) -> DataFrame:
    return accuracy.withColumn("status", F.when((F.col("mismatched_count") > 0) & F.col("category").isin(*ZERO_TOLERANCE), "FAIL").otherwise(F.col("status")))


def group_differences(diffs: DataFrame, by: list[str], order: list[str], k: int = 3) -> DataFrame:
    """Number of differences of each group with its first ``k`` samples, joined as text.

    One row for each group and value of the order columns comes out of the first aggregation, which Spark pre-aggregates; only the
    ``k`` first of a group are gathered. Where ``diffs`` has columns ``n`` and ``samples``, rows in which both are set are grouped
    already and pass through.
    """
    done = None
    if {"n", "samples"} <= {*diffs.columns}:
        grouped = F.col("n").isNotNull() & F.col("samples").isNotNull()
        done, diffs = diffs.where(grouped).select(*by, "n", "samples"), diffs.where(~grouped)
    text = F.concat_ws("=>", F.coalesce("expected", F.lit("<NULL>")), F.coalesce("actual", F.lit("<NULL>")))
    ranked = Window.partitionBy(*by)
    rows = diffs.groupBy(*by, *order, text.alias("_x")).agg(F.count("*").alias("_c"))
    first = rows.select(*by, "_x", F.row_number().over(ranked.orderBy(*order, "_x")).alias("_rank"), F.sum("_c").over(ranked).alias("n")).where(F.col("_rank") <= k)
    out = first.groupBy(*by).agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_x"))), lambda s: s["_x"]), "; ").alias("samples"))
    return out if done is None else out.unionByName(done)


def sample_diffs(diffs: DataFrame, order: list[str], k: int, by: list[str] = ()) -> DataFrame:
    """The first ``k`` rows of each group, or of all without groups."""
    if not by:
        return diffs.orderBy(*order).limit(k)
    return diffs.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def difference_summary(diffs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(grp, n): the four groups source_only, target_only, duplicate and field, also where they are empty.

    ``totals(grp, n)`` gives declared numbers, which stand in for groups of which no difference is listed.
    """
    t = F.col("diff_type")
    grp = F.when(t.endswith("TARGET_MISSING"), "source_only").when(t.endswith("TARGET_EXTRA"), "target_only").when(t.endswith("DUPLICATE"), "duplicate").otherwise("field")
    spec = diffs.sparkSession.createDataFrame([(g,) for g in ("source_only", "target_only", "duplicate", "field")], "grp string")
    counts = diffs.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))
    out = F.broadcast(spec).join(counts, "grp", "left")
    if totals is None:
        return out.select("grp", F.coalesce("n", F.lit(0)).alias("n"))
    declared = totals.groupBy("grp").agg(F.sum("n").alias("_n"))
    return out.join(declared, "grp", "left").select("grp", F.coalesce("n", "_n", F.lit(0)).alias("n"))


def strict_vs_normalized(joined: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """(field, strict, normalized, observations): differences of the raw values, of the normalised ones, and those that vanish by normalising."""
    one = joined.where("sn = 1 and tn = 1")
    counts = one.agg(*[x for i in range(len(rules)) for x in (F.count_if(~F.col(f"s.r{i}").eqNullSafe(F.col(f"t.r{i}"))).alias(f"a{i}"), F.count_if(~F.col(f"s.f{i}").eqNullSafe(F.col(f"t.f{i}"))).alias(f"b{i}"), F.count_if(~F.col(f"s.r{i}").eqNullSafe(F.col(f"t.r{i}")) & F.col(f"s.f{i}").eqNullSafe(F.col(f"t.f{i}"))).alias(f"c{i}"))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r.column).alias("field"), F.col(f"a{i}").alias("strict"), F.col(f"b{i}").alias("normalized"), F.col(f"c{i}").alias("observations")) for i, r in enumerate(rules)])))


#: Texts that stand for no value.
SENTINELS = ("", "null", "none", "n/a", "0", "-1", "1970-01-01 00:00:00")


def tag_causes(diffs: DataFrame, scale: int = 2) -> DataFrame:
    """``cause`` of each field difference: null_or_sentinel, whitespace_case, rounding, unit_scale or other, in this order."""
    e, a = F.col("expected"), F.col("actual")
    x, y = e.try_cast("decimal(30,6)"), a.try_cast("decimal(30,6)")
    gone = lambda c: c.isNull() | F.lower(F.trim(c)).isin(*SENTINELS)
    ratio = F.lit(False)
    for f in (100, 1000, 1_000_000):
        ratio = ratio | (x == y * f) | (y == x * f)
    cause = F.when(gone(e) | gone(a), "null_or_sentinel").when(F.lower(F.regexp_replace(e, r"\s+", "")) == F.lower(F.regexp_replace(a, r"\s+", "")), "whitespace_case").when(F.abs(x - y) <= F.lit(str(10.0**-scale)).cast("decimal(18,6)"), "rounding").when(ratio & (x != 0), "unit_scale").otherwise("other")
    return diffs.withColumn("cause", cause)


def verdict_by_policy(joined: DataFrame, field: int, scales: list[int], kinds=("s", "t")) -> DataFrame:
    """(policy, mismatched, verdict) of a numeric field without rounding and rounded at each scale."""
    one = joined.where("sn = 1 and tn = 1")
    a, b = (F.col(f"{k}.r{field}") for k in kinds)
    raw = lambda c: c.try_cast("decimal(38,10)")
    checks = {"exact": ~raw(a).eqNullSafe(raw(b))} | {f"scale_{n}": ~F.round(raw(a), n).eqNullSafe(F.round(raw(b), n)) for n in scales}
    counts = one.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("mismatched"), F.when(F.col(n) == 0, "PASS").otherwise("FAIL").alias("verdict")) for n in checks])))


def time_evidence(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, earliest, latest) of each time column, in one pass."""
    found = df.agg(*[x for i, c in enumerate(cols) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))])
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), show(F.col(f"a{i}")).alias("earliest"), show(F.col(f"b{i}")).alias("latest")) for i, c in enumerate(cols)])))


def except_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``; repeated rows count. One grouping of signed counts, which Spark pre-aggregates."""
    cols = a.columns
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    left = signed.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return left.select(*cols, side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_i")).drop("_i")


def value_profile(df: DataFrame, cols: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """(field, n_rows, n_null, n_empty, n_zero, n_default, label) of each column, in one pass.

    label: all_null, all_empty, all_zero, all_default, mixed (only such values) or business.
    """
    defaults = defaults or {}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        text = F.trim(F.col(c).cast("string"))
        number = text.try_cast("decimal(38,6)")
        aggs += [F.count_if(text.isNull()).alias(f"u{i}"), F.count_if(text == "").alias(f"e{i}"), F.count_if(number == 0).alias(f"z{i}"), F.count_if((text == defaults.get(c)) & (F.coalesce(number, F.lit(1)) != 0) if c in defaults else F.lit(False)).alias(f"d{i}")]
    rows = []
    for i, c in enumerate(cols):
        n, u, e, z, d = F.col("n"), F.col(f"u{i}"), F.col(f"e{i}"), F.col(f"z{i}"), F.col(f"d{i}")
        label = F.when(u == n, "all_null").when(e == n, "all_empty").when(z == n, "all_zero").when(d == n, "all_default").when(u + e + z + d == n, "mixed").otherwise("business")
        rows.append(F.struct(F.lit(c).alias("field"), n.alias("n_rows"), u.alias("n_null"), e.alias("n_empty"), z.alias("n_zero"), d.alias("n_default"), label.alias("label")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
