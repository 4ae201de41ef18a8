"""Field rules and the column expressions they compile to. Everything runs inside Spark's expressions; nothing raises on data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts tried, in order, for date and time text.
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")

#: Texts that count as zero, and spellings of true and false.
ZEROS = ("0", "0.0", "0.00")
TRUE = ("1", "true", "yes", "y")
FALSE = ("0", "false", "no", "n")


# ---- JSON paths: absent is not null -----------------------------------------------------------

def parse_json(c: Column) -> Column:
    """VARIANT, null where the text is not JSON."""
    return F.try_parse_json(c)


def json_get(v: Column, path: str) -> Column:
    """The VARIANT at ``path``: SQL null if the path is absent, a variant null if the JSON value is null."""
    if "*" in path:
        raise ValueError(f"wildcard in path {path}")
    return F.try_variant_get(v, path, "variant")


def json_exists(v: Column, path: str) -> Column:
    return json_get(v, path).isNotNull()


def json_text(v: Column, path: str) -> Column:
    """Text of a scalar or the JSON of anything else; null for absent and for JSON null."""
    return F.try_variant_get(v, path, "string")


# ---- transforms ---------------------------------------------------------------------------------

def empty_to_null(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def zero_to_null(c: Column) -> Column:
    return F.when(~F.coalesce(c.cast("string").isin(*ZEROS), F.lit(False)), c.cast("string"))


def cents_to_decimal(c: Column) -> Column:
    return (c.cast("string").try_cast("decimal(30,4)") / 100).cast("decimal(30,4)").cast("string")


def unix_seconds(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c.cast("string").try_cast("decimal(20,0)").cast("long")), "yyyy-MM-dd HH:mm:ss")


def unix_millis(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c.cast("string").try_cast("decimal(20,0)").cast("long")), "yyyy-MM-dd HH:mm:ss")


def unix_auto(c: Column) -> Column:
    """Numbers over 1e10 are milliseconds, others seconds."""
    return F.when(c.cast("string").try_cast("decimal(20,0)") > 10_000_000_000, unix_millis(c)).otherwise(unix_seconds(c))


def spec_to_text(c: Column) -> Column:
    """JSON list of {name, value} to ``name:value;...``."""
    items = F.from_json(c.cast("string"), "array<struct<name string, value string>>")
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["name"], x["value"])), ";")


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys and no blanks; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c.cast("string"))), c.cast("string"))


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "empty_to_null": empty_to_null,
    "zero_to_null": zero_to_null,
    "cents_to_decimal": cents_to_decimal,
    "unix_seconds": unix_seconds,
    "unix_millis": unix_millis,
    "unix_auto": unix_auto,
    "spec_to_text": spec_to_text,
    "json_dumps": canonical_json,
}


#: Transforms that make null of a value by intent. Null from any other named transform means that it could not read the value.
NULLING = ("empty_to_null", "zero_to_null")


def transform_chain(c: Column, names) -> Column:
    return reduce(lambda x, n: (TRANSFORMS[n] if isinstance(n, str) else n)(x), names, c)


def transform_failed(c: Column, names) -> Column:
    """Some named transform of the chain could not read its value."""
    failed = F.lit(False)
    for n in names:
        after = transform_chain(c, (n,))
        if isinstance(n, str) and n not in NULLING:
            failed = failed | (c.isNotNull() & after.isNull())
        c = after
    return failed


#: The computed fields that mapping files know by name, over the parsed document ``v`` and the source row.
COMPUTED: dict[str, Callable[[Column], Column]] = {
    "zero_order_amount": lambda v: ~truthy_number(json_text(v, "$.order_amount")),
    "pre_sale_type_nonzero": lambda v: truthy_number(json_text(v, "$.pre_sale_type")),
    "source_id": lambda v: F.col("source_id"),
}


def map_values(df: DataFrame, col: str, mapping: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """``df`` with ``col`` mapped by ``mapping(from_value, to_value)``, its first row for each value; unmapped values pass through.

    Maps of up to ``max_broadcast`` values are broadcast, larger ones are joined by a shuffle.
    """
    pairs = mapping.select(F.col("from_value").cast("string").alias("_from"), "to_value").groupBy("_from").agg(F.min("to_value").alias("_to"))
    small = pairs.limit(max_broadcast + 1).count() <= max_broadcast
    joined = df.join(F.broadcast(pairs) if small else pairs, F.col(col).cast("string") == F.col("_from"), "left")
    return joined.withColumn(col, F.coalesce("_to", F.col(col).cast("string"))).drop("_from", "_to")


def value_map(c: Column, mapping: dict[str, str]) -> Column:
    """Mapped values by their text; unmapped ones pass through. For maps that do not fit an expression see ``map_values``."""
    if not mapping:
        return c.cast("string")
    pairs = F.create_map(*[F.lit(str(x)) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c.cast("string")), c.cast("string"))


def range_map(c: Column, ranges: list[tuple[float, float, str]], default: str | None = None) -> Column:
    """The name of the closed range that holds the code."""
    out = F.lit(default).cast("string")
    for low, high, name in reversed(ranges):
        out = F.when(c.between(low, high), F.lit(name)).otherwise(out)
    return out


# ---- typed normalisation ----------------------------------------------------------------------

def norm_datetime(c: Column, formats=DATETIME_FORMATS) -> Column:
    text = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats] + [text.try_cast("timestamp")]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd HH:mm:ss")


def norm(c: Column, kind: str, scale: int = 2, trim: bool = False, formats=DATETIME_FORMATS) -> Column:
    """Canonical text of a value of the given kind; null for null and for what cannot be read.

    Kinds: string, int (toward zero), decimal (half up at ``scale``), bool, datetime (whole seconds), date, json; others pass through.
    """
    text = c.cast("string")
    if kind == "int":
        number = text.try_cast("decimal(38,9)")
        return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("string")
    if kind == "decimal":
        return text.try_cast(f"decimal(38,{scale})").cast("string")
    if kind == "bool":
        low = F.lower(F.trim(text))
        return F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false")
    if kind == "datetime":
        return norm_datetime(text, formats)
    if kind == "date":
        return F.substring(norm_datetime(text, formats), 1, 10)
    if kind == "json":
        return canonical_json(text)
    return F.trim(text) if trim else text


def norm_error(raw: Column, normal: Column) -> Column:
    """There was a value, and it could not be read."""
    return raw.isNotNull() & normal.isNull()


def scaled(c: Column, factor) -> Column:
    """Units brought to one scale, in decimal."""
    return (c.cast("string").try_cast("decimal(30,6)") * F.lit(str(factor)).cast("decimal(18,6)")).cast("decimal(38,6)").cast("string")


def truthy_number(c: Column) -> Column:
    """A number other than zero; other text counts if it is not empty."""
    number = c.cast("string").try_cast("decimal(38,9)")
    return F.when(number.isNotNull(), number != 0).otherwise(F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)))


# ---- keys and names ----------------------------------------------------------------------------

def canonical_key(*cols: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<NULL>")) for c in cols])


def norm_text(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens; camel case and digits split, other letters one by one are kept together."""
    split = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.regexp_extract_all(F.lower(split), F.lit(r"([\p{L}]+|[0-9]+)"), 1))


def header_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s_/()\-]+", ""))


def alnum_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]+", ""))


def snake_case(c: Column) -> Column:
    split = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def mapping_type(c: Column) -> Column:
    """One of seven kinds from an SQL type name, by the first group of substrings that occurs."""
    text = F.lower(F.coalesce(c, F.lit("")))
    groups = [("decimal", "decimal|numeric|number|float|double|money"), ("int", "int|long"), ("datetime", "time"), ("date", "date"), ("bool", "bool|bit"), ("json", "json|object|array")]
    out = F.lit("string")
    for name, pattern in reversed(groups):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def type_compatible(api: Column, column: Column) -> Column:
    a, b = mapping_type(api), mapping_type(column)
    return (F.coalesce(api, F.lit("")) == "") | (a == b) | (b == "string") | ((a == "int") & (b == "decimal"))


#: Spellings of required and optional.
REQUIRED = ("true", "yes", "y", "1", "required", "must", "是", "必填", "必须", "非空", "no-null", "not null")
OPTIONAL = ("false", "no", "n", "0", "optional", "否", "非必填", "可空", "允许为空", "nullable")


def required_flag(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*REQUIRED), True).when(low.isin(*OPTIONAL), False)


#: Statuses by their spellings.
STATUSES = {
    "passed": ("pass", "passed", "success", "ok"),
    "failed": ("fail", "failed", "error"),
    "blocked": ("blocked", "block"),
    "warning": ("warning", "warn", "risk"),
    "skipped": ("skipped", "skip"),
}


def norm_status(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    out = F.lit("unknown")
    for name, spellings in STATUSES.items():
        out = F.when(low.isin(*spellings), name).otherwise(out)
    return out


def norm_version(c: Column) -> Column:
    """``v1.2`` and ``1.2`` alike become ``V1.2``."""
    text = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return F.when(text == "", "").when(text.startswith("V"), text).otherwise(F.concat(F.lit("V"), text))


def version_match(c: Column, target: str) -> Column:
    """exact: only the target stands in the cell; mixed: it stands with others; excluded: it does not stand."""
    wanted = target.upper() if target.upper().startswith("V") else "V" + target.upper()
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"(V?\d+(?:\.\d+)*)"), 1), norm_version))
    return F.when(~F.array_contains(found, wanted), "excluded").when(F.size(found) == 1, "exact").otherwise("mixed")


def split_notes(c: Column) -> Column:
    """Sentences, cut at sentence marks that do not stand between digits."""
    parts = F.split(collapse_ws(c), r"(?<![0-9])[.;。；]\s*|[.;。；]\s*(?![0-9])")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def content_key(c: Column) -> Column:
    """Text without list numbers, white space and punctuation, for comparing contents."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^\s*\d+[.、)]\s*", "")
    return F.lower(F.regexp_replace(bare, r"[\s\p{Punct}，。；：、（）]+", ""))


def empty_side_range(df: DataFrame, by: list[str], source: str, target: str) -> DataFrame:
    """(by, side, n, first_key, last_key): how many rows of each group have which side empty, with the least and greatest ``key``."""
    return df.groupBy(*by, empty_side(F.col(source), F.col(target)).alias("side")).agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def empty_side(source: Column, target: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    return F.when(blank(source) & blank(target), "both_empty").when(blank(target), "target_empty").when(blank(source), "source_empty").when(source.cast("string") != target.cast("string"), "both_set_different").otherwise("same")


# ---- rules ----------------------------------------------------------------------------------------

MISSING = object()


@dataclass(frozen=True)
class FieldRule:
    """How a target column follows from the source, and how both sides are normalised before comparing."""

    column: str
    json_path: str | None = None
    fallback_paths: tuple[str, ...] = ()
    source_column: str | None = None
    constant: object = MISSING
    computed: Column | str | None = None
    kind: str = "string"
    scale: int = 2
    source_transforms: tuple = ()
    target_transforms: tuple = ()
    source_map: tuple[tuple[str, str], ...] = ()
    target_map: tuple[tuple[str, str], ...] = ()
    default: object = MISSING
    required: bool = False
    ignore_if_source_missing: bool = False
    empty_as_null: bool = False
    trim: bool = False
    scale_factor: float | None = None
    category: str = "business"

    def missing(self, v: Column | None, side: str = "source") -> Column:
        """The source says nothing of this field: no path of it exists. Null is something said."""
        if side == "target" or self.constant is not MISSING or self.computed is not None or self.source_column or not self.json_path:
            return F.lit(False)
        return ~F.coalesce(reduce(lambda a, b: a | b, [json_exists(v, p) for p in (self.json_path, *self.fallback_paths)]), F.lit(False))

    def raw(self, v: Column | None = None, side: str = "source") -> Column:
        """The value before normalising. Of the target that is its column; of the source the constant, else computed, else source
        column, else the first path that exists, else the default."""
        if side == "target":
            return F.col(f"`{self.column}`").cast("string")
        if self.constant is not MISSING:
            return F.lit(self.constant).cast("string")
        if self.computed is not None:
            return (COMPUTED[self.computed](v) if isinstance(self.computed, str) else self.computed).cast("string")
        if self.source_column or not self.json_path:
            return F.col(f"`{self.source_column or self.column}`").cast("string")
        out = F.lit(None if self.default is MISSING else self.default).cast("string")
        for p in reversed((self.json_path, *self.fallback_paths)):
            out = F.when(json_exists(v, p), json_text(v, p)).otherwise(out)
        return out

    @property
    def origin(self) -> str:
        """Where the source value comes from, for reports."""
        return self.json_path or self.source_column or (str(self.computed) if isinstance(self.computed, str) else "<computed>" if self.computed is not None else "<constant>" if self.constant is not MISSING else self.column)

    def _prepared(self, raw: Column, side: str) -> tuple[Column, Column]:
        """(value that is to be read as the kind, an earlier step could not read it)."""
        chain, mapping = (self.source_transforms, self.source_map) if side == "source" else (self.target_transforms, self.target_map)
        c = empty_to_null(raw) if self.empty_as_null else raw
        failed = transform_failed(c, chain)
        c = value_map(transform_chain(c, chain), dict(mapping))
        if self.scale_factor is not None and side == "source":
            failed = failed | (c.isNotNull() & scaled(c, self.scale_factor).isNull())
            c = scaled(c, self.scale_factor)
        return c, failed

    def normal(self, raw: Column, side: str) -> Column:
        return norm(self._prepared(raw, side)[0], self.kind, self.scale, self.trim)

    def error(self, raw: Column, side: str) -> Column:
        """There was a value after the transforms, or before one that failed, and it could not be read. Values emptied by intent are none."""
        c, failed = self._prepared(raw, side)
        return failed | norm_error(c, norm(c, self.kind, self.scale, self.trim))

    def blank(self, raw: Column) -> Column:
        """No value, for required fields: null, or empty where empty counts as null."""
        return (empty_to_null(raw) if self.empty_as_null else raw).isNull()


def raw_table(df: DataFrame, rules: list[FieldRule], side: str = "source", json_col: str | None = None, keep: list[str] = ()) -> DataFrame:
    """One projection with ``<column>__raw`` and ``<column>__missing`` for each rule, besides ``keep``.

    ``json_col``: the column of the documents that the rules' paths read; a VARIANT is taken as it is, text is parsed once.
    """
    v = F.col("_v") if json_col else None
    rows = df
    if json_col:
        parsed = df.schema[json_col].dataType.typeName() == "variant"
        rows = df.withColumn("_v", F.col(json_col) if parsed else parse_json(F.col(json_col)))
    return rows.select(*keep, *[x for r in rules for x in (r.raw(v, side).alias(f"{r.column}__raw"), r.missing(v, side).alias(f"{r.column}__missing"))])


def normalize_table(df: DataFrame, rules: list[FieldRule], side: str = "source", json_col: str | None = None, keep: list[str] = ()) -> DataFrame:
    """One projection with ``<column>``, ``<column>__raw``, ``<column>__error`` and ``<column>__missing`` for each rule, besides ``keep``; see ``raw_table``."""
    raws = raw_table(df, rules, side, json_col, keep)
    raw = lambda r: F.col(f"`{r.column}__raw`")
    return raws.select("*", *[r.normal(raw(r), side).alias(r.column) for r in rules if r.column not in keep], *[r.error(raw(r), side).alias(f"{r.column}__error") for r in rules])
