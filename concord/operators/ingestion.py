"""Checking JSON documents against the header and detail tables that they were loaded into."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.normalize import FieldRule, canonical_key, json_exists, json_get, json_text, norm, parse_json
from ..sources.shared import written
from .reconcile import _fields, field_cells, key_names, union_diffs


def parsed(df: DataFrame, col: str) -> Column:
    """The document as VARIANT: a column of that type as it is, text parsed. Parse once and pass the result on where several checks follow."""
    return F.col(col) if df.schema[col].dataType.typeName() == "variant" else parse_json(F.col(col))


def parse_documents(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``col`` as VARIANT, null where it is no JSON."""
    return df.withColumn(col, parsed(df, col))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def check_json(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """(keep, json_status): ok, SOURCE_JSON_INVALID or SOURCE_JSON_NOT_OBJECT."""
    v = F.col("_v")
    rows = df.withColumn("_v", parsed(df, col))
    return rows.select(*keep, F.when(v.isNull(), "SOURCE_JSON_INVALID").when(~_is_object(v), "SOURCE_JSON_NOT_OBJECT").otherwise("ok").alias("json_status"))


def check_keys(df: DataFrame, json_col: str, paths: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep, part, problem) of the key parts that are absent, null, blank or cannot be read. ``paths``: path to kind."""
    v = F.col("_v")
    found = []
    for path, kind in paths.items():
        text = json_text(v, path)
        problem = F.when(~json_exists(v, path), "missing").when(text.isNull(), "null").when(F.trim(text) == "", "blank").when(norm(text, kind).isNull(), "unreadable")
        found.append(F.struct(F.lit(path).alias("part"), problem.alias("problem")))
    rows = df.withColumn("_v", parsed(df, json_col)).where(_is_object(v))
    return rows.select(*keep, F.inline(F.filter(F.array(*found), lambda x: x["problem"].isNotNull())))


def detail_array_status(df: DataFrame, json_col: str, path: str, keep: list[str], required: bool = False) -> DataFrame:
    """(keep, status, n_items): ok, absent or DETAIL_ARRAY_NOT_LIST for each document that is an object."""
    v = F.col("_v")
    item = json_get(v, path)
    items = F.try_variant_get(v, path, "array<variant>")
    rows = df.withColumn("_v", parsed(df, json_col)).where(_is_object(v))
    absent = "DETAIL_REQUIRED_ARRAY_MISSING" if required else "absent"
    return rows.select(*keep, F.when(item.isNull(), absent).when(items.isNull(), "DETAIL_ARRAY_NOT_LIST").otherwise("ok").alias("status"), F.coalesce(F.size(items), F.lit(0)).alias("n_items"))


def explode_details(df: DataFrame, json_col: str, path: str, keep: list[str]) -> DataFrame:
    """(keep, detail_index, item): one row for each element of the detail array, ``item`` a VARIANT."""
    items = F.try_variant_get(parsed(df, json_col), path, "array<variant>")
    return df.select(*keep, F.posexplode(items).alias("detail_index", "item"))


def project_items(items: DataFrame, fields: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Typed columns of exploded items; ``fields``: column to (path, kind)."""
    return items.select(*keep, *[norm(json_text(F.col("item"), path), kind).alias(name) for name, (path, kind) in fields.items()])


def attach_details(headers: DataFrame, details: DataFrame, key: str, foreign_key: str) -> DataFrame:
    """Details with the columns of their header, by an equi-join on the configured columns."""
    return headers.join(details, headers[key] == details[foreign_key])


def compare_details(source: DataFrame, target: DataFrame, parent: list[str], keys: list[str] | None, fields: list[FieldRule], order_by: list[str] | None = None) -> DataFrame:
    """Differences of details within their parents; both sides hold ``parent``, the key and the field columns.

    With ``keys``: missing, extra, duplicate on either side, and differing fields of keys that stand once on both. Without: the
    n-th row by ``order_by`` on one side against the n-th on the other, fields only.
    """
    if keys is None:
        at = Window.partitionBy(*parent).orderBy(*order_by)
        source, target = (df.withColumn("_at", F.row_number().over(at)) for df in (source, target))
        keys = ["_at"]
    by = [*parent, *keys]

    def sided(df: DataFrame, side: str, name: str) -> DataFrame:
        values = F.struct(*[r.normal(F.col(f"`{r.column}`").cast("string"), side).alias(f"f{i}") for i, r in enumerate(fields)])
        return df.groupBy(*by).agg(F.count("*").alias(f"{name}n"), F.min(values).alias(name))

    both = sided(source, "source", "s").join(sided(target, "target", "t"), by, "full_outer")
    key = canonical_key(*[F.col(k) for k in by]).alias("business_key")
    single = (F.col("sn") == 1) & (F.col("tn") == 1)
    none = F.lit(None).cast("string")
    cell = lambda when, kind, field=none, e=none, a=none: F.when(when, F.struct(F.lit(kind).alias("diff_type"), field.alias("field"), e.alias("expected"), a.alias("actual")))
    if keys != ["_at"]:
        cells = [cell(F.col("tn").isNull(), "DETAIL_TARGET_MISSING"), cell(F.col("sn").isNull(), "DETAIL_TARGET_EXTRA"), cell(F.col("sn") > 1, "DETAIL_SOURCE_KEY_DUPLICATE"), cell(F.col("tn") > 1, "DETAIL_TARGET_KEY_DUPLICATE")]
    else:
        cells = []
    for i, r in enumerate(fields):
        cells.append(cell(F.coalesce(single, F.lit(False)) & ~F.col(f"s.f{i}").eqNullSafe(F.col(f"t.f{i}")), "DETAIL_FIELD_MISMATCH", F.lit(r.column), F.col(f"s.f{i}"), F.col(f"t.f{i}")))
    return both.select(key, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def detail_count_mismatch(source: DataFrame, target: DataFrame, parent: list[str]) -> DataFrame:
    """(parent, expected, actual) where both sides have details in different numbers."""
    a, b = (df.groupBy(*parent).agg(F.count("*").alias(n)) for df, n in ((source, "expected"), (target, "actual")))
    return a.join(b, parent).where("expected <> actual")


def orphans(detail: DataFrame, header: DataFrame, foreign_key: str, key: str, limit: int | None = None) -> DataFrame:
    """Details without a header; at most ``limit`` of them for a report."""
    found = detail.join(header.select(F.col(key).alias("_key")), F.col(foreign_key) == F.col("_key"), "left_anti")
    return found if limit is None else found.limit(limit)


class _Repeated(ValueError):
    """An object names a key twice, which no VARIANT can hold."""


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Repeated
    return out


def _number(text: str) -> str:
    """The kind that a JSON number has as VARIANT: whole ones up to 64 bits, then decimals of up to 38 digits without an exponent, then doubles."""
    if text.lstrip("-").isdigit() and -(1 << 63) <= int(text) < 1 << 63:
        return "BIGINT"
    digits = text.lstrip("-").replace(".", "")
    return "DECIMAL" if digits.isdigit() and len(digits.lstrip("0")) <= 38 and len(text.partition(".")[2]) <= 38 else "DOUBLE"


class _Kind(str):
    """The kind of a number, in its place."""


def _refuse(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=lambda t: _Kind(_number(t)), parse_float=lambda t: _Kind(_number(t)), parse_constant=_refuse)


def decode(text: str):
    """A document with kinds in place of its numbers."""
    return _DECODER.decode(text)


_KINDS = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", type(None): "VOID"}


class PathTrie:
    """Paths of documents as a tree: a node is [children by step, counts by kind]; ``size`` is the number of its nodes."""

    def __init__(self):
        self.root: list = [{}, {}]
        self.size = 1

    def add(self, value, depth: int | None) -> None:
        todo = [(self.root, value, 1)]
        while todo:
            node, v, level = todo.pop()
            kind = v if type(v) is _Kind else _KINDS[type(v)]
            node[1][kind] = node[1].get(kind, 0) + 1
            if depth is not None and level >= depth or not isinstance(v, (dict, list)):
                continue
            for step, inner in v.items() if isinstance(v, dict) else ((None, x) for x in v):
                child = node[0].get(step)
                if child is None:
                    child = node[0][step] = [{}, {}]
                    self.size += 1
                todo.append((child, inner, level + 1))

    def rows(self):
        """(path, kind, n) of every node."""
        todo = [("$", self.root)]
        while todo:
            path, (children, kinds) = todo.pop()
            for kind, n in kinds.items():
                yield path, str(kind), n
            for step, child in children.items():
                todo.append((path + ("[*]" if step is None else f".{step}"), child))


#: Nodes of a task's tree of paths, after which its counts are sent on and it starts anew.
TRIE_NODES = 100_000


def json_paths(df: DataFrame, json_col: str, depth: int | None = None) -> DataFrame:
    """(path, kind, n): every path of the documents with the kinds of its values; array elements are ``[*]``. ``depth`` bounds the levels, by default nothing does.

    One pass: each task adds its documents to a tree of paths and sends its counts, which Spark adds up; the plan is the same for
    every depth. Texts that are no JSON, or that no VARIANT can hold, count nothing.
    """

    def run(batches):
        trie = PathTrie()
        for b in batches:
            for text in b.column(0).to_pylist():
                try:
                    value = decode(text)
                except (ValueError, TypeError, RecursionError):
                    continue
                trie.add(value, depth)
                if trie.size > TRIE_NODES:
                    yield _path_rows(trie)
                    trie = PathTrie()
        yield _path_rows(trie)

    text = F.to_json(json_col) if df.schema[json_col].dataType.typeName() == "variant" else F.col(json_col)
    return df.select(text.alias("text")).where("text is not null").mapInArrow(run, "path string, kind string, n long").groupBy("path", "kind").agg(F.sum("n").alias("n"))


def _path_rows(trie: PathTrie) -> pa.RecordBatch:
    found = list(trie.rows())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.int64())], ["path", "kind", "n"])


def parse_params(df: DataFrame, col: str, keys: dict[str, str], keep: list[str]) -> DataFrame:
    """Typed values of an embedded JSON parameter text; null where it is no object or lacks the key. ``keys``: name to type."""
    v = parsed(df, col)
    held = F.when(_is_object(v), v)
    return df.select(*keep, *[F.try_variant_get(held, f"$.{k}", t).alias(k) for k, t in keys.items()])



# ---- the whole check ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class DocumentSpec:
    """How documents were loaded: their id and JSON columns, key and field rules of the header table, and the same for the detail
    table, whose ``detail_fk`` refers to ``header_id``, or to ``detail_source_fk``, a column that comes with the documents. Without
    ``detail_keys`` details are matched by place, in ``detail_order``."""

    id_col: str
    json_col: str
    keys: tuple[FieldRule, ...]
    fields: tuple[FieldRule, ...]
    header_id: str
    detail_path: str | None = None
    detail_required: bool = False
    detail_fk: str | None = None
    detail_keys: tuple[FieldRule, ...] = ()
    detail_fields: tuple[FieldRule, ...] = ()
    detail_order: tuple[str, ...] = ()
    orphan_limit: int | None = None
    detail_source_fk: str | None = None


def _key(names: list[str]) -> Column:
    return canonical_key(*[F.col(n) for n in names])


def _found(when: Column, kind: str, **more: Column) -> Column:
    """A difference under a condition, with the fields that all differences of documents have."""
    text = {c: F.lit(None).cast("string") for c in ("json_path", "field", "expected", "actual", "expected_raw", "actual_raw")} | {"n": F.lit(None).cast("long"), "error": F.lit(None).cast("string")}
    return F.when(when, F.struct(F.lit(kind).alias("diff_type"), *[more.get(c, v).alias(c) for c, v in text.items()]))


def _cells(when: Column, cells: list[Column]) -> list[Column]:
    """Field cells as differences under a condition."""
    return [F.when(when & c["diff_type"].isNotNull(), F.struct(c["diff_type"].alias("diff_type"), *[c[n].alias(n) for n in ("json_path", "field", "expected", "actual", "expected_raw", "actual_raw")], F.lit(None).cast("long").alias("n"), c["error"].alias("error"))) for c in cells]


def _listed(*cells: Column) -> Column:
    return F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull()))


def _keyed(df: DataFrame, rules: tuple[FieldRule, ...], fields: tuple[FieldRule, ...], side: str, name: str, json_col: str | None, keep: list[str], blank_lost: bool = False) -> tuple[DataFrame, list[str]]:
    """``df`` with the normalised key parts ``<name>k0``.., ``<name>lost`` (a part is absent; with ``blank_lost`` also null or blank), ``<name>bad`` (a part cannot be read) and the fields as struct ``name``."""
    rows = _fields(df, keep, [*rules, *fields], side, "_all", json_col).withColumnsRenamed(dict(zip(key_names(keep), keep)))
    part = lambda i, x: F.col(f"_all.{x}{i}")
    any_ = lambda xs: F.exists(F.array(F.lit(False), *xs), lambda x: x)
    names = [f"{name}k{i}" for i in range(len(rules))]
    empty = lambda i: F.coalesce(F.trim(part(i, "r").cast("string")), F.lit("")) == ""
    lost = any_([empty(i) if blank_lost else part(i, "m") | (F.lit(r.required) & part(i, "r").isNull()) for i, r in enumerate(rules)])
    own = [part(i + len(rules), x).alias(f"{x}{i}") for i in range(len(fields)) for x in "frem"] or [F.lit(0).alias("none")]
    bad = any_([part(i, "e") & ~empty(i) if blank_lost else part(i, "e") for i in range(len(rules))])
    return rows.select(*keep, *[part(i, "f").alias(n) for i, n in enumerate(names)], lost.alias(f"{name}lost"), bad.alias(f"{name}bad"), F.struct(*own).alias(name)), names


def checked_documents(docs: DataFrame, header: DataFrame, spec: DocumentSpec, details: DataFrame | None = None) -> DataFrame:
    """One row for each document with its ``_status``, key parts, fields ``s``, detail array, the value ``_fk`` that its details refer to, and the header row of its key: ``tn`` rows, fields ``t``, ``header``.

    ``details(_n_fk, _n_details)``, the number of detail rows of each value referred to, are joined to the headers where these are what
    is referred to, so that whole documents are dealt out once; else to the documents.
    """
    source_fk = F.col(f"`{spec.detail_source_fk}`") if spec.detail_source_fk in docs.columns else F.lit(None).cast("string")
    rows = docs.withColumns({"_doc": parsed(docs, spec.json_col), "_source_fk": source_fk, "_id": F.col(f"`{spec.id_col}`").cast("string")})
    rows = rows.withColumn("_status", F.when(F.col("_doc").isNull(), "SOURCE_JSON_INVALID").when(~_is_object(F.col("_doc")), "SOURCE_JSON_NOT_OBJECT"))
    if spec.detail_path:
        item = json_get(F.col("_doc"), spec.detail_path)
        rows = rows.withColumn("_items", F.try_variant_get("_doc", spec.detail_path, "array<variant>")).withColumn("_absent", item.isNull() | F.is_variant_null(item))
    else:
        rows = rows.withColumn("_items", F.lit(None).cast("array<variant>")).withColumn("_absent", F.lit(True))
    own, names = _keyed(rows, spec.keys, spec.fields, "source", "s", "_doc", ["_id", "_status", "_items", "_absent", "_source_fk"], blank_lost=True)
    held, there = _keyed(header.withColumn("_header", F.col(f"`{spec.header_id}`")), spec.keys, spec.fields, "target", "t", None, ["_header"])
    one = held.groupBy(*there).agg(F.count("*").alias("tn"), F.min("t").alias("t"), F.min("_header").alias("header"))
    if details is not None and not spec.detail_source_fk:
        one = one.join(details, F.col("header").cast("string") == F.col("_n_fk"), "left").drop("_n_fk")
    ok = F.col("_status").isNull() & ~F.col("slost") & ~F.col("sbad")
    own = own.select("*", ok.alias("_ok")).select("*", *[F.when(F.col("_ok"), F.col(n)).alias(f"_{n}") for n in names])
    same = None
    for a, b in zip(names, there):
        both = (F.col(f"_{a}") == F.col(b)) if same is None else same & (F.col(f"_{a}") == F.col(b))
        same = both
    found = own.join(one, same, "left").drop(*there, *[f"_{n}" for n in names])
    found = found.withColumn("_fk", F.col("_source_fk") if spec.detail_source_fk else F.col("header").cast("string")).withColumn("_one", F.coalesce(F.col("_ok") & (F.col("tn") == 1), F.lit(False)))
    if details is not None and spec.detail_source_fk:
        found = found.join(details, F.when(F.col("_one"), F.col("_fk")) == F.col("_n_fk"), "left").drop("_n_fk")
    return found


def _compare_items(checked: DataFrame, detail: DataFrame, spec: DocumentSpec) -> DataFrame:
    """Differences of the detail arrays of ``checked`` documents and the detail rows they refer to.

    Every document is compared by itself, by its number ``_row``. Its items and the rows that it refers to are dealt out by the value
    referred to, which serves all joins and groupings.
    """
    own = checked.select("_row", "_id", "_order", "_fk", F.posexplode("_items").alias("_at", "_item"))
    items, names = _keyed(own, spec.detail_keys, spec.detail_fields, "source", "s", "_item", ["_row", "_id", "_order", "_fk", "_at"])
    cells = field_cells([*spec.detail_fields], "DETAIL", detail.columns)
    refer = checked.select("_row", "_id", "_order", "_fk")
    keyed = detail.withColumn("_detail_fk", F.col(f"`{spec.detail_fk}`").cast("string"))
    rows, there = _keyed(keyed, spec.detail_keys, spec.detail_fields, "target", "t", None, ["_detail_fk", *spec.detail_order])
    place = [F.col("_id").alias("source_id"), F.col("_order").alias("business_key")]
    if not spec.detail_keys:
        nth = F.row_number().over(Window.partitionBy("_detail_fk").orderBy(*(spec.detail_order or ["t"]))) - 1
        held = refer.join(rows.select("_detail_fk", nth.alias("_at"), "t"), F.col("_fk") == F.col("_detail_fk")).select("_row", "_at", "t")
        both = items.join(held, ["_row", "_at"])
        return both.select(*place, F.col("_at").cast("string").alias("detail_key"), F.col("_at").alias("detail_index"), _listed(*_cells(F.lit(True), cells)))
    lost = items.where("slost or sbad").select(*place, _key(names).alias("detail_key"), F.col("_at").alias("detail_index"), F.when(F.col("sbad"), "DETAIL_SOURCE_KEY_ERROR").otherwise("DETAIL_SOURCE_KEY_MISSING").alias("diff_type"))
    wrong = rows.where("tbad").join(refer, F.col("_fk") == F.col("_detail_fk")).select(*place, F.lit("DETAIL_TARGET_KEY_ERROR").alias("diff_type"))
    parts = [f"_k{i}" for i in range(len(names))]
    by = ["_place", "_row", "_id", "_order", *parts]
    nowhere = F.concat(F.lit("\0"), F.col("_row").cast("string"))
    left = items.where("not sbad").withColumnsRenamed(dict(zip(names, parts))).withColumn("_place", F.coalesce("_fk", nowhere)).select(*by, "_at", "s").repartition("_place")
    held = rows.where("not tbad").withColumnsRenamed(dict(zip(there, parts))).repartition("_detail_fk").groupBy("_detail_fk", *parts).agg(F.count("*").alias("tn"), F.min("t").alias("t"))
    right = refer.join(held, F.col("_fk") == F.col("_detail_fk")).withColumn("_place", F.col("_fk")).select(*by, "tn", "t")
    met = left.unionByName(right, allowMissingColumns=True).groupBy(*by)
    both = met.agg(F.count("_at").alias("_sn"), F.min("_at").alias("_at"), F.min("s").alias("s"), F.max("tn").alias("tn"), F.min("t").alias("t")).withColumn("sn", F.when(F.col("_sn") > 0, F.col("_sn")))
    single = (F.col("sn") == 1) & (F.col("tn") == 1)
    found = [_found(F.col("sn") > 1, "DETAIL_SOURCE_KEY_DUPLICATE", n=F.col("sn")), _found(F.col("tn") > 1, "DETAIL_TARGET_KEY_DUPLICATE", n=F.col("tn")), _found(F.col("tn").isNull(), "DETAIL_TARGET_MISSING"), _found(F.col("sn").isNull(), "DETAIL_TARGET_EXTRA")]
    kinds = both.select(*place, _key(parts).alias("detail_key"), F.col("_at").alias("detail_index"), _listed(*found, *_cells(F.coalesce(single, F.lit(False)), cells)))
    return union_diffs(lost, wrong, kinds)


def verify_ingestion(docs: DataFrame, header: DataFrame, detail: DataFrame | None, spec: DocumentSpec, counts: Observation | None = None) -> DataFrame:
    """Every difference between JSON documents and the header and detail tables that they were loaded into, under ``DIFF_SCHEMA``.

    Documents are parsed and checked, their keys built, the header row of each looked up and its fields compared, then the detail
    array matched with the detail rows of that header; details without a header and keys of several documents come beside it.
    A document whose key has a null, blank, absent or unreadable part, no header or several, is not compared further. Every row is
    a document of its own, also where ids repeat. Where ``detail_source_fk`` is not among the columns of ``docs`` the details cannot be
    looked up: DETAIL_FETCH_ERROR.

    Documents are read, parsed and joined once, into a table in the shared folder; ``counts`` observes that pass.
    """
    details = bool(spec.detail_path) and detail is not None
    fetched = spec.detail_source_fk is None or spec.detail_source_fk in docs.columns
    n = detail.groupBy(F.col(f"`{spec.detail_fk}`").cast("string").alias("_n_fk")).agg(F.count("*").alias("_n_details")) if details else None
    checked = checked_documents(docs, header, spec, n).withColumn("_order", _key([f"sk{i}" for i in range(len(spec.keys))]))
    if counts is not None:
        held = F.coalesce(F.sum(F.when(F.col("_one"), F.col("_n_details"))), F.lit(0)) if details else F.lit(0)
        checked = checked.observe(counts, F.count("*").alias("source_rows"), F.count_if(F.col("_status").isNull()).alias("valid_json"), F.count_if("_one").alias("headers_checked"), held.cast("long").alias("details_checked"))
    checked = written(checked.withColumn("_row", F.monotonically_increasing_id()), "checked")
    good, valid, one = F.col("_ok"), F.col("_status").isNull(), F.col("_one")
    found = [_found(~valid & (F.col("_status") == x), x) for x in ("SOURCE_JSON_INVALID", "SOURCE_JSON_NOT_OBJECT")]
    found += [_found(valid & F.col("sbad"), "ORDER_SOURCE_KEY_ERROR"), _found(valid & ~F.col("sbad") & F.col("slost"), "ORDER_SOURCE_KEY_MISSING"), _found(good & F.col("tn").isNull(), "ORDER_TARGET_MISSING"), _found(good & (F.col("tn") > 1), "ORDER_TARGET_DUPLICATE", n=F.col("tn"))]
    found += _cells(one, field_cells([*spec.fields], "ORDER", header.columns))
    parts = []
    if details and not fetched:
        found.append(_found(one, "DETAIL_FETCH_ERROR", error=F.lit(f"no column {spec.detail_source_fk}")))
    elif details:
        listed = F.col("_absent") | F.col("_items").isNotNull()
        path = F.lit(spec.detail_path)
        here, there = F.when(F.col("_absent"), 0).otherwise(F.size("_items")), F.coalesce("_n_details", F.lit(0))
        found += [_found(one & F.col("_absent") & F.lit(spec.detail_required), "DETAIL_ARRAY_MISSING", json_path=path), _found(one & ~listed, "DETAIL_ARRAY_NOT_LIST", json_path=path), _found(one & listed & (here != there), "DETAIL_COUNT_MISMATCH", expected=here.cast("string"), actual=there.cast("string"))]
        parts.append(_compare_items(checked.where(one & listed), detail, spec))
    if details:
        lost = orphans(detail, header, spec.detail_fk, spec.header_id, spec.orphan_limit)
        parts.append(lost.select(F.lit("ORPHAN_DETAIL").alias("diff_type"), F.col(f"`{spec.detail_fk}`").cast("string").alias("business_key"), canonical_key(*[F.col(f"`{r.column}`") for r in spec.detail_keys]).alias("detail_key")))
    order = F.when(valid & ~F.col("sbad"), F.col("_order"))
    documents = checked.select(F.col("_id").alias("source_id"), order.alias("business_key"), _listed(*found))
    twice = checked.where(good).groupBy("_order").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("SOURCE_BUSINESS_KEY_DUPLICATE").alias("diff_type"), F.col("_order").alias("business_key"), "n")
    return union_diffs(documents, twice, *parts)


def ingestion_summary(docs: DataFrame, header: DataFrame, detail: DataFrame, spec: DocumentSpec) -> tuple[DataFrame, DataFrame]:
    """(summary, diffs): one row (source_rows, valid_json, headers_checked, details_checked, diffs) for a run of ``verify_ingestion``, and its differences.

    The first four numbers are observed while the documents are checked; nothing is read for them again.
    """
    counts = Observation()
    diffs = verify_ingestion(docs, header, detail, spec, counts)
    seen = counts.get
    return diffs.agg(*[F.lit(seen[n]).cast("long").alias(n) for n in ("source_rows", "valid_json", "headers_checked", "details_checked")], F.count("*").alias("diffs")), diffs
