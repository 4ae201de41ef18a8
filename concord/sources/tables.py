"""Readers and writers by declared specs, catalogues, and texts that hold tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import header_key


@dataclass(frozen=True)
class SourceSpec:
    """Where rows are and which: format and path or JDBC options, id and document columns, more columns with names, filter, order and limit."""

    format: str = "parquet"
    path: str | None = None
    options: dict = field(default_factory=dict)
    id_column: str | None = None
    json_column: str | None = None
    extra: tuple[tuple[str, str], ...] = ()
    where: str | None = None
    order_by: tuple[str, ...] = ()
    limit: int | None = None


def jdbc_options(url: str, dbtable: str, user: str, password_env: str, partition_column: str, lower: int, upper: int, partitions: int = 64) -> dict:
    """Options for a partitioned JDBC read or write of MySQL or PostgreSQL; the password comes from the environment of the driver.

    ``lookup.read_by_quantiles`` finds bounds by itself, ``lookup.fetch_by_keys`` reads what keys point to, ``runs.commit_rows`` writes so that it may be repeated.
    """
    import os

    driver = {"mysql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver"}[url.split(":")[1]]
    return {"url": url, "dbtable": dbtable, "user": user, "password": os.environ[password_env], "driver": driver, "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The rows of a spec; a name that repeats is taken once, and an order only holds with a limit."""
    df = spark.read.format(spec.format).options(**spec.options).load(*([spec.path] if spec.path else []))
    if spec.where:
        df = df.where(spec.where)
    wanted = {}
    for name, alias in [*((c, c) for c in (spec.id_column, spec.json_column) if c), *spec.extra]:
        wanted.setdefault(alias.lower(), (name, alias))
    if spec.limit is not None:
        df = (df.orderBy(*spec.order_by) if spec.order_by else df).limit(spec.limit)
    return df.select(*[F.col(n).alias(a) for n, a in wanted.values()]) if wanted else df


def write_result(df: DataFrame, path: str, format: str = "parquet", by: list[str] = (), mode: str = "overwrite") -> None:
    df.write.format(format).mode(mode).partitionBy(*by).save(path)


def write_rows(df: DataFrame, target: str, options: dict | None = None) -> None:
    """Append rows to a table, or by JDBC where options are given."""
    if options:
        df.write.format("jdbc").options(**options).mode("append").save()
    else:
        df.write.mode("append").saveAsTable(target)


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame], comments: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, data_type, is_nullable, ordinal_position, column_comment, ..) of the given tables; comments come from field metadata, else from ``comments(table_name, column_name, column_comment)``."""
    rows = [(t, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", i, f.metadata.get("comment"), None, None, False) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    schema = "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int, column_comment string, numeric_scale int, column_default string, is_primary boolean"
    out = spark.createDataFrame(rows, schema)
    if comments is not None:
        out = out.join(comments.withColumnRenamed("column_comment", "_c"), ["table_name", "column_name"], "left").withColumn("column_comment", F.coalesce("column_comment", "_c")).drop("_c")
    return out


def information_catalog(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """The catalogue from ``information_schema``: its ``columns``, and ``keys(table_name, column_name, constraint_type)`` with a row for each constraint a column is in."""
    flags = keys.groupBy("table_name", "column_name").agg(F.max(F.upper("constraint_type").contains("PRIMARY")).alias("is_primary"), F.max(F.upper("constraint_type").rlike("PRIMARY|UNIQUE")).alias("is_unique"))
    held = {c.lower(): c for c in columns.columns}
    get = lambda name, kind: (F.col(held[name]) if name in held else F.lit(None)).cast(kind)
    own = columns.select("table_name", "column_name", F.lower("data_type").alias("data_type"), F.upper("is_nullable").alias("is_nullable"), (get("ordinal_position", "int") - 1).alias("ordinal_position"), F.nullif(F.trim(get("column_comment", "string")), F.lit("")).alias("column_comment"), get("character_maximum_length", "int").alias("max_length"), get("numeric_precision", "int").alias("numeric_precision"), get("numeric_scale", "int").alias("numeric_scale"), get("column_default", "string").alias("column_default"))
    joined = own.join(flags, ["table_name", "column_name"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_primary", "is_unique")})


def load_catalog(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their usual names from tables that name them otherwise: the first alias with a value that is not blank."""
    held = {c.lower(): c for c in df.columns}
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return df.select(*[(F.coalesce(*own) if (own := [text(held[a.lower()]) for a in aliases if a.lower() in held]) else F.lit(None).cast("string")).alias(n) for n, aliases in names.items()])


def markdown_table_rows(df: DataFrame, text_col: str, headers: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """(keep, row, names..): rows of Markdown tables in a text column. A header fits a name by an alias exactly, else by containment."""
    lines = df.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("line", "x")).where(F.trim("x").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("x"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells)
    separator = F.forall("cells", lambda c: c.rlike("^:?-{2,}:?$"))
    at = Window.partitionBy(*keep).orderBy("line")
    marked = rows.withColumn("sep", separator).withColumn("next", F.lead("sep").over(at))
    marked = marked.withColumn("head", F.last(F.when(F.col("next"), F.transform("cells", header_key)), ignorenulls=True).over(at))
    body = marked.where(~F.col("sep") & ~F.coalesce("next", F.lit(False)) & F.col("head").isNotNull())

    def cell(aliases: list[str]):
        keys = [header_key(F.lit(a)) for a in aliases]
        exact = F.greatest(*[F.array_position("head", k) for k in keys], F.lit(0))
        loose = F.array_position(F.transform("head", lambda h: F.greatest(*[h.contains(k).cast("int") for k in keys], F.lit(0))), F.lit(1))
        return F.get("cells", (F.when(exact > 0, exact).when(loose > 0, loose) - 1).cast("int"))

    return body.select(*keep, F.row_number().over(at).alias("row"), *[cell(a).alias(n) for n, a in headers.items()])


def load_suites(suites: DataFrame, results: DataFrame) -> DataFrame:
    """Cases of each suite from JSON texts in which they stand under cases, results, test_results, items or at the top; suites without a result stay, with a reason."""
    v = F.try_parse_json("content")
    top = "array<variant>"
    cases = F.coalesce(*[F.try_variant_get(v, p, top) for p in ("$.cases", "$.results", "$.test_results", "$.items", "$")])
    read = results.select("suite_id", cases.alias("cases"))
    joined = suites.join(read, "suite_id", "left").withColumn("reason", F.when(F.col("cases").isNull(), "no readable result"))
    opened = joined.select(*suites.columns, "reason", F.posexplode_outer("cases").alias("ordinal", "c"))
    get = lambda k, t="string": F.try_variant_get("c", f"$.{k}", t)
    item = lambda a, k, t="string": F.try_variant_get(a, f"$.{k}", t)
    checks = F.transform(get("assertions", "array<variant>"), lambda a: F.struct(item(a, "check").alias("check"), item(a, "expected").alias("expected"), item(a, "actual").alias("actual"), item(a, "passed", "boolean").alias("passed")))
    shots = F.transform(get("screenshots", "array<variant>"), lambda a: F.coalesce(item(a, "path"), F.try_variant_get(a, "$", "string")))
    return opened.select(*suites.columns, "reason", "ordinal", get("id").alias("id"), get("title").alias("title"), get("status").alias("status"), checks.alias("assertions"), shots.alias("screenshots"), get("related_cases", "array<string>").alias("related_cases"))
