"""Keeping one row of several: the fullest, the best, the first, the last, the latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _ranked(df: DataFrame, key: list, order: list) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def keep_fullest(df: DataFrame, key: list[str], length: Column, order: list[str], source: str | None = None) -> DataFrame:
    """The row with the longest content of each key, the first by ``order`` on ties, with ``n_copies`` and, given ``source``, the sources of the others.

    The best row is found by a pre-aggregated maximum, so a key that a third of all rows share is no group in memory.
    """
    best = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(length, *[-F.col(o) for o in order])).alias("_best"), F.count("*").alias("n_copies"), *([F.array_sort(F.collect_set(source)).alias("_sources")] if source else []))
    out = best.select("_best.*", "n_copies", *(["_sources"] if source else []))
    return out.withColumn("other_sources", F.array_except("_sources", F.array(source))).drop("_sources") if source else out


def keep_best(df: DataFrame, key: list, score: Column, order: list[str]) -> DataFrame:
    """The row of the highest score of each key, the first by ``order`` on ties."""
    return _ranked(df, key, [score.desc(), *order])


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, key, order)


def last_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, key, [F.col(o).desc() for o in order])


def latest_snapshot(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each object by date, batch and update time; all its columns stay, so the full match key remains a locator."""
    return last_by(df, key, order)


def _ranks_by_range(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the rank from 1 within ``group``: rows are dealt out by range, so that one group spreads over tasks, and a row's rank is its place in its range plus what the group has in earlier ones."""
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_row", F.monotonically_increasing_id())
    placed = written(dealt.withColumn("_range", F.shiftright("_row", 33)), "ranked")
    parts = placed.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_g", "_r", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & (placed["_range"] == starts["_r"])).withColumn(name, F.col("_row") + F.col("_shift")).drop("_row", "_range", "_g", "_r", "_shift")


def suffix_duplicates(df: DataFrame, name: str, order: list[str], most: int = 1_000_000) -> DataFrame:
    """``unique_name``: name, name_2, name_3 .. in order. Names of more than ``most`` rows are numbered over many tasks, others each in one."""
    hot = df.groupBy(F.col(name).alias("_hot")).count().where(F.col("count") > most).select("_hot")
    window = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    if hot.isEmpty():
        ranked = df.withColumn("_at", window)
    else:
        hot = F.broadcast(written(hot, "hot"))
        large, small = (df.join(hot, df[name].eqNullSafe(hot["_hot"]), how) for how in ("left_semi", "left_anti"))
        ranked = _ranks_by_range(large, name, order, "_at").unionByName(small.withColumn("_at", window))
    return ranked.withColumn("unique_name", F.when(F.col("_at") == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), F.col("_at")))).drop("_at")


def dedupe_statements(df: DataFrame, title: str, text: str) -> DataFrame:
    """``class`` of each statement: exact_duplicate, format_duplicate, title_variant, retitled or unique, in this order.

    All numbers come from one aggregation by title and hashes, and return to the rows by one join; null titles and texts count as
    values.
    """
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.col(text), r"\s+", "")), r";+$", "")
    hashed = lambda c: F.coalesce(F.md5(c), F.lit(""))
    rows = df.withColumn("_title", hashed(F.col(title).cast("string"))).withColumn("_exact", hashed(F.col(text))).withColumn("_plain", hashed(plain))
    exact = rows.groupBy("_title", "_plain", "_exact").agg(F.count("*").alias("_n_exact"))
    same = exact.groupBy("_title", "_plain").agg(F.sum("_n_exact").alias("_n_same"))
    titles = same.groupBy("_title").agg(F.count("*").alias("_n_texts"))
    texts = same.groupBy("_plain").agg(F.count("*").alias("_n_titles"))
    kind = F.when(F.col("_n_exact") > 1, "exact_duplicate").when(F.col("_n_same") > 1, "format_duplicate").when(F.col("_n_texts") > 1, "title_variant").when(F.col("_n_titles") > 1, "retitled").otherwise("unique")
    known = exact.join(same, ["_title", "_plain"]).join(titles, "_title").join(texts, "_plain").select("_title", "_exact", kind.alias("class"))
    return rows.join(known, ["_title", "_exact"]).select(*df.columns, "class")


def reference_rows(df: DataFrame, cols: list[str], n: int, distinct: bool = True, most: int | None = None) -> DataFrame:
    """(row_index, cols): the first ``n`` distinct rows by value, or the distinct rows repeated in turn up to ``n``.

    Too few distinct rows are an error with ``distinct``, none at all without, more than ``most`` (if given) wanted ones too. Rows are
    ranked over many tasks and met by rank, so neither their number nor ``n`` has a bound.
    """
    if most is not None and n > most:
        raise ValueError(f"{n} reference rows, at most {most}")
    base = df.select(*cols).distinct().withColumn("_one", F.lit(0))
    ranked = _ranks_by_range(base, "_one", cols, "_at").where(F.col("_at") <= n).select((F.col("_at") - 1).cast("long").alias("_at"), *cols)
    m = ranked.count()
    if m < (n if distinct else min(n, 1)):
        raise ValueError(f"{m} distinct reference rows, {n} wanted")
    if distinct:
        return ranked.select(F.col("_at").alias("row_index"), *cols)
    turns = df.sparkSession.range(n).withColumnRenamed("id", "row_index").withColumn("_at", F.col("row_index") % max(m, 1))
    return turns.join(ranked, "_at").select("row_index", *cols)
