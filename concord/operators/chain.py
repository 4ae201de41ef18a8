"""Relations through an id map, file attributes, and chains of two or three layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_relations(source: DataFrame, id_map: DataFrame, target: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, finding) for relations child to parent, compared in the target's ids; one row a child.

    ``id_map(old_id, new_id)`` translates parents. unmapped: the source's parent has no new id; missing: the target lacks the
    child; different: it points elsewhere; extra: the source lacks it. Repeated relations and map entries count once; a child with
    several parents, or a parent with several new ids, must have just those in the target.
    """
    named = id_map.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_p")).distinct()
    own = source.select(F.col(child).alias("_c"), F.col(parent).alias("_r")).distinct()
    left = own.join(named, F.col("_r") == F.col("_o"), "left").select("_c", "_p", (F.col("_r").isNotNull() & F.col("_p").isNull()).alias("_lost"), F.lit(1).alias("_s"), F.lit(0).alias("_t"))
    right = target.select(F.col(child).alias("_c"), F.col(parent).alias("_p"), F.lit(False).alias("_lost"), F.lit(0).alias("_s"), F.lit(1).alias("_t"))
    once = left.union(right).groupBy("_c", "_p").agg(F.bool_or("_lost").alias("_lost"), F.max("_s").alias("_s"), F.max("_t").alias("_t"))
    both = once.groupBy("_c").agg(F.bool_or("_lost").alias("_lost"), F.max("_s").alias("_s"), F.max("_t").alias("_t"), F.bool_or(F.col("_s") != F.col("_t")).alias("_other"))
    finding = F.when(F.col("_s") == 0, "extra").when(F.col("_lost"), "unmapped").when(F.col("_t") == 0, "missing").when(F.col("_other"), "different")
    return both.select(F.col("_c").alias("child"), finding.alias("finding")).where("finding is not null")


def check_files(source: DataFrame, target: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """(key, finding): file missing, extra, or an attribute that differs; both sides hold one row for each file and kind."""
    names = {a: f"_t_{a}" for a in attributes}
    right = target.select(*key, *[F.col(a).alias(n) for a, n in names.items()], F.lit(True).alias("_has"))
    both = source.select(*key, *attributes, F.lit(True).alias("_src")).join(right, key, "full_outer")
    found = F.array(F.when(F.col("_has").isNull(), F.lit("missing")), F.when(F.col("_src").isNull(), F.lit("extra")), *[F.when(F.col("_src") & F.col("_has") & ~F.col(a).eqNullSafe(F.col(n)), F.lit(f"different_{a}")) for a, n in names.items()])
    return both.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def reconcile_staged(layers: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """(keys, first_layer, lost_at) of the keys that some layer lacks; ``lost_at`` is the first layer after the first without it."""
    rows = reduce(DataFrame.union, [df.select(*keys).distinct().withColumn("_layer", F.lit(i)) for i, (_, df) in enumerate(layers)])
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("_layer")).alias("held"))
    names = F.array(*[F.lit(n) for n, _ in layers])
    every = F.sequence(F.lit(0), F.lit(len(layers) - 1))
    first = F.col("held")[0]
    lost = F.filter(every, lambda i: (i > first) & ~F.array_contains(F.col("held"), i))
    name = lambda i: F.get(names, i)
    return held.where(F.size("held") < len(layers)).select(*keys, name(first).alias("first_layer"), F.when(F.size(lost) > 0, name(lost[0])).alias("lost_at"))


def stage_counts(layers: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """(stage, kept, lost, gained) of each pair of neighbouring layers and of the whole chain."""
    pairs = [*zip(layers, layers[1:])] + ([(layers[0], layers[-1])] if len(layers) > 2 else [])

    def one(a: tuple[str, DataFrame], b: tuple[str, DataFrame]) -> DataFrame:
        left, right = (df.select(*keys).distinct().withColumn(n, F.lit(True)) for (_, df), n in ((a, "_a"), (b, "_b")))
        both = left.join(right, keys, "full_outer")
        return both.agg(F.lit(f"{a[0]}->{b[0]}").alias("stage"), F.count_if(F.col("_a") & F.col("_b")).alias("kept"), F.count_if(F.col("_b").isNull()).alias("lost"), F.count_if(F.col("_a").isNull()).alias("gained"))

    return reduce(DataFrame.union, [one(a, b) for a, b in pairs])


def chain_type(results: DataFrame, by: list[str]) -> DataFrame:
    """staged where any row has staging evidence, else direct."""
    staged = F.bool_or((F.coalesce(F.col("staging_id").cast("string"), F.lit("")) != "") | (F.coalesce(F.col("staging_evidence").cast("string"), F.lit("")) != ""))
    return results.groupBy(*by).agg(F.when(staged, "staged").otherwise("direct").alias("chain_type"))


def document_mapping(source: DataFrame, target: DataFrame, back: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, finding): request, readback and writeback of one document must agree in every field."""
    sides = [("s", source), ("t", target), ("b", back)]
    both = reduce(lambda a, b: a.join(b, keys, "full_outer"), [df.select(*keys, F.struct(*fields).alias(n)) for n, df in sides])
    found = [F.when(F.col("t").isNull(), F.lit("not_in_target")), F.when(F.col("b").isNull(), F.lit("not_written_back")), F.when(F.col("s").isNull(), F.lit("not_in_source"))]
    found += [F.when(F.col("s").isNotNull() & F.col("t").isNotNull() & F.col("b").isNotNull() & ~(F.col(f"s.{f}").eqNullSafe(F.col(f"t.{f}")) & F.col(f"t.{f}").eqNullSafe(F.col(f"b.{f}"))), F.lit(f"different_{f}")) for f in fields]
    return both.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("finding"))
