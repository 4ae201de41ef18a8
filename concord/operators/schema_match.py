"""Drafting a mapping: every column of a table is scored against every field of an interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import mapping_type, norm_text, token_set, type_compatible


def scope_fields(fields: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Header fields, and detail fields under the array ``prefix`` with their ``relative_path``."""
    inside = F.col("json_path").startswith(prefix + "[*]")
    relative = F.concat(F.lit("$"), F.substring(F.col("json_path"), len(prefix) + 4, 10_000))
    return fields.where(~inside), fields.where(inside).withColumn("relative_path", relative)


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _grams(text: Column, size: int) -> Column:
    """Every stretch of ``size`` characters of a text."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))


#: Comments are looked up in others by stretches of three characters, shorter ones by all of theirs.
GRAM = 3


def _held(short: DataFrame, short_keys: list[str], long: DataFrame, long_keys: list[str]) -> DataFrame:
    """Pairs in which the text ``x`` of ``short`` stands inside that of ``long``.

    Postings of the stretches of 1 to ``GRAM`` characters of the long texts, a row for each stretch of a text; a short text looks up
    only that of its longest stretches which stands in the fewest long ones, and what it finds is compared in full.
    """
    posted = long.where("x <> ''").select(*long_keys, F.col("x").alias("whole"), F.explode(F.array_distinct(F.concat(*[_grams(F.col("x"), n) for n in range(1, GRAM + 1)]))).alias("gram"))
    sizes = posted.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.least(F.length("x"), F.lit(GRAM))
    own = F.when(size == 1, _grams(F.col("x"), 1)).when(size == 2, _grams(F.col("x"), 2)).otherwise(_grams(F.col("x"), GRAM))
    asked = short.where("x <> ''").select(*short_keys, "x", F.explode(F.array_distinct(own)).alias("gram")).join(sizes, "gram", "left")
    # A stretch that no long text has rules the text out.
    best = asked.groupBy(*short_keys, "x").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return best.join(posted, "gram").where(F.contains("whole", "x")).select(*short_keys, *long_keys)


def _comment_score(fcn: Column, ccn: Column, fct: Column, cct: Column) -> Column:
    return F.when((fcn == "") | (ccn == ""), 0.0).when(fcn == ccn, 0.72).when(ccn.contains(fcn) | fcn.contains(ccn), 0.58).otherwise(_jaccard(fct, cct) * 0.48)


def _type_score(field_type: Column, data_type: Column) -> Column:
    both = (F.coalesce(field_type, F.lit("")) != "") & (F.coalesce(data_type, F.lit("")) != "")
    return F.when(type_compatible(field_type, data_type), 0.08).when(both, -0.12).otherwise(0.0)


def _score(parts: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts)), 6)


def _sparse_pairs(c: DataFrame, f: DataFrame) -> DataFrame:
    """Pairs of ``c`` and ``f`` that can be a column's best: those in which a name counts, and for each column the best of the others.

    Where no name counts, a score follows from both comments and types alone. So columns of one comment and type have one best class
    of fields of one comment and type, and of that the first field in the interface. Classes are met by shared tokens, equal comments
    or one comment inside the other; any other class scores by its type only, for which the first field of each type stands.
    """
    names = ["table_name", "column_name"]
    keyed = lambda df, x: df.withColumn("_t", F.explode(F.array_distinct(F.concat(*[F.transform(F.col(t), lambda v, n=n: F.concat(F.lit(n), v)) for t, n in x]))))
    met = lambda left, right: left.select(*names, "_t").join(right.select("json_path", "_t"), "_t").select(*names, "json_path")
    named = met(keyed(c, (("cct", "c"), ("cnt", "c"))), keyed(f, (("fnt", "c"),))).union(met(keyed(c, (("cnt", "c"),)), keyed(f, (("fct", "c"),))))
    equal = met(c.select(*names, F.col("cnn").alias("_t")).where("_t <> ''"), f.select("json_path", F.col("fnn").alias("_t")))
    place = F.struct("field_ordinal", "json_path")
    cc = c.groupBy("ccn", "cct", "data_type").agg(F.min(F.struct(*names)).alias("_c"))
    fc = f.groupBy("fcn", "fct", "field_type").agg(F.min(place).alias("place")).withColumn("_f", F.col("place.json_path"))
    shared = keyed(cc, (("cct", "t"),)).select("_c", "_t").join(keyed(fc, (("fct", "t"),)).select("_f", "_t"), "_t").select("_c", "_f")
    same = cc.select("_c", F.col("ccn").alias("_t")).where("_t <> ''").join(fc.select("_f", F.col("fcn").alias("_t")), "_t").select("_c", "_f")
    left, right = cc.select("_c", F.col("ccn").alias("x")), fc.select("_f", F.col("fcn").alias("x"))
    held = _held(right, ["_f"], left, ["_c"]).select("_c", "_f").union(_held(left, ["_c"], right, ["_f"]).select("_c", "_f"))
    first = fc.groupBy(mapping_type(F.col("field_type")).alias("_m"), (F.coalesce("field_type", F.lit("")) == "").alias("_e")).agg(F.min("place").alias("place"))
    typed = cc.select("_c").join(F.broadcast(first.select(F.col("place.json_path").alias("_f"))))
    pairs = shared.union(same).union(held).union(typed).distinct().join(cc, "_c").join(fc, "_f")
    score = _score(_comment_score(F.col("fcn"), F.col("ccn"), F.col("fct"), F.col("cct")) + _type_score(F.col("field_type"), F.col("data_type")))
    best = pairs.groupBy("ccn", "cct", "data_type").agg(F.min_by("_f", F.struct(-score, "place")).alias("json_path"))
    keys = lambda df, x: df.select("*", F.struct(F.col("ccn"), F.col("cct"), F.col("data_type")).alias(x))
    classed = keys(c, "_k").select(*names, "_k").join(keys(best, "_b").select("_b", "json_path"), F.col("_k").eqNullSafe(F.col("_b"))).select(*names, "json_path")
    return named.union(equal).union(classed).distinct()


def score_pairs(columns: DataFrame, fields: DataFrame, only_best: bool = False, max_broadcast: int = 10_000) -> DataFrame:
    """Each column and field with its ``score`` in 0..1 and the ``reasons``.

    Comments weigh most (equal 0.72, contained 0.58, shared tokens up to 0.48), names less (0.48, 0.36), name against comment up to
    0.22 each from half the tokens on, and types 0.08 or -0.12 (fixed values). All pairs come out, up to ``max_broadcast`` fields by
    broadcast; with ``only_best`` just those that can be a column's best (``_sparse_pairs``), by joins over postings, which is the way
    for large catalogues.
    """
    c = columns.select("table_name", "column_name", "data_type", F.coalesce("column_comment", F.lit("")).alias("cc"), "is_nullable", "ordinal_position", "numeric_scale")
    f = fields.select("json_path", F.col("name").alias("field_name"), F.coalesce("comment", F.lit("")).alias("fc"), F.col("type").alias("field_type"), "required", "field_ordinal")
    c = c.withColumns({"ccn": norm_text(F.col("cc")), "cnn": norm_text(F.col("column_name")), "cct": token_set(F.col("cc")), "cnt": token_set(F.col("column_name"))})
    f = f.withColumns({"fcn": norm_text(F.col("fc")), "fnn": norm_text(F.col("field_name")), "fct": token_set(F.col("fc")), "fnt": token_set(F.col("field_name"))})
    if only_best:
        pairs = _sparse_pairs(c, f).join(c, ["table_name", "column_name"]).join(f, "json_path")
    else:
        pairs = c.join(F.broadcast(f) if f.limit(max_broadcast + 1).count() <= max_broadcast else f)
    comment = _comment_score(F.col("fcn"), F.col("ccn"), F.col("fct"), F.col("cct"))
    name = F.when((F.col("fnn") == "") | (F.col("cnn") == ""), 0.0).when(F.col("fnn") == F.col("cnn"), 0.48).otherwise(_jaccard(F.col("fnt"), F.col("cnt")) * 0.36)
    cross = lambda a, b, when: F.when(when & (_jaccard(a, b) >= 0.5), _jaccard(a, b) * 0.22).otherwise(0.0)
    name_comment = cross(F.col("fnt"), F.col("cct"), F.col("ccn") != "")
    comment_name = cross(F.col("fct"), F.col("cnt"), F.col("fcn") != "")
    kind = _type_score(F.col("field_type"), F.col("data_type"))
    scored = pairs.withColumns({"s_comment": comment, "s_name": name, "s_cross": name_comment + comment_name, "s_type": kind})
    score = _score(F.col("s_comment") + F.col("s_name") + F.col("s_cross") + F.col("s_type"))
    reasons = F.filter(F.array(F.when(F.col("s_comment") > 0, F.lit("comment")), F.when(F.col("s_name") > 0, F.lit("name")), F.when(F.col("s_cross") > 0, F.lit("name_comment")), F.when(F.col("s_type") > 0, F.lit("type"))), lambda x: x.isNotNull())
    return scored.select("table_name", "column_name", "data_type", "is_nullable", "ordinal_position", "numeric_scale", "json_path", "field_name", "field_type", "required", "field_ordinal", score.alias("score"), reasons.alias("reasons"))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.55, "review").when(score > 0, "low").otherwise("unmatched")


def best_candidates(pairs: DataFrame) -> DataFrame:
    """The best field of each column, the first in the interface on ties, with ``confidence`` and a flag where the field wins several columns."""
    rank = Window.partitionBy("table_name", "column_name").orderBy(F.desc("score"), "field_ordinal", "json_path")
    best = pairs.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank").withColumn("confidence", confidence(F.col("score")))
    shared = best.where("score > 0").groupBy("json_path").agg((F.count("*") > 1).alias("conflict"))
    return best.join(shared, "json_path", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def draft_mappings(best: DataFrame) -> DataFrame:
    """Mappings of high and review confidence with their kind, decimal scale (default 2) and whether they are required."""
    kind = mapping_type(F.coalesce(F.nullif("data_type", F.lit("")), "field_type"))
    return best.where(F.col("confidence").isin("high", "review")).select("table_name", "column_name", "json_path", kind.alias("kind"), F.when(kind == "decimal", F.coalesce("numeric_scale", F.lit(2))).alias("scale"), (F.coalesce("required", F.lit(False)) | (F.upper("is_nullable") == "NO")).alias("required"), "confidence", "score")


#: Preferred key columns, best first.
BUSINESS_KEYS = ("order_no", "order_code", "source_order_no", "order_id")
DETAIL_KEYS = ("line_no", "line_num", "sku_id", "sku_code", "item_id", "goods_id", "product_id")


def infer_keys(mappings: DataFrame, preferred=BUSINESS_KEYS, path_name: str | None = "orderno") -> DataFrame:
    """The mapping of the most preferred key column of each table; without such a column one whose JSON path holds ``path_name``."""
    rank = F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.lower("column_name")), F.lit(0))
    if path_name:
        rank = F.coalesce(rank, F.when(norm_text(F.col("json_path")).contains(path_name), len(preferred) + 1))
    found = mappings.withColumn("_rank", rank).where("_rank > 0")
    return found.withColumn("_first", F.row_number().over(Window.partitionBy("table_name").orderBy("_rank", "column_name"))).where("_first = 1").drop("_rank", "_first")


def unmatched(best: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns without a field, and fields that no column chose."""
    return best.where("confidence = 'unmatched'").select("table_name", "column_name"), fields.join(best.where("score > 0").select("json_path"), "json_path", "left_anti")
