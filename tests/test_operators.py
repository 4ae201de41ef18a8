"""Facts, properties and awkward rows of the operators."""

import pytest
from pyspark.sql import functions as F

from concord.functions import normalize as N
from concord.functions import redact as R
from concord.operators import datagen, dedupe, ingestion, locators, pages, reconcile, responses
from concord.plans.fixtures import ORDER_RULES, orders, orders_copy
from concord.sources import tables


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_missing_is_not_null(spark):
    v = N.parse_json(F.lit('{"a": {"b": [{"c": 1}]}, "n": null, "s": ""}'))
    r = one(spark, N.json_text(v, "$.a.b[0].c"), N.json_exists(v, "$.n"), N.json_text(v, "$.n"), N.json_exists(v, "$.x"), N.json_exists(v, "$.a.b[5]"), N.json_text(v, "$.s"))
    assert tuple(r) == ("1", True, None, False, False, "")
    with pytest.raises(ValueError):
        N.json_get(v, "$.a[*]")


def test_normalisers(spark):
    text = lambda x: F.lit(x).cast("string")
    r = one(spark, N.norm(text("12.345"), "decimal"), N.norm(text("1.005"), "decimal"), N.norm(text("-1.9"), "int"), N.norm(text(" YES "), "bool"), N.norm(text("2024/01/02 03:04:05"), "datetime"), N.norm(text("2024-01-02T03:04:05Z"), "datetime"), N.norm(text("20240102"), "date"), N.norm(text("x"), "int"), N.norm(text('{"b":1, "a":[2]}'), "json"), N.norm(text(None), "bool"))
    assert tuple(r) == ("12.35", "1.01", "-1", "true", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02", None, '{"a":[2],"b":1}', None)


def test_transforms(spark):
    r = one(spark, N.zero_to_null(F.lit("0.00")), N.empty_to_null(F.lit("")), N.cents_to_decimal(F.lit("1234")).cast("decimal(18,2)").cast("string"), N.cents_to_decimal(F.lit("x")), N.unix_millis(F.lit("1700000000123")), N.value_map(F.lit("PAID"), {"PAID": "paid"}), N.value_map(F.lit("?"), {"PAID": "paid"}), N.canonical_key(F.lit(1), F.lit(None)))
    assert tuple(r) == (None, None, "12.34", None, "2023-11-14 22:13:20", "paid", "?", "1|<NULL>")


def test_rules_fall_back_only_when_missing(spark):
    rules = [N.FieldRule("a", json_path="$.x", fallback_paths=("$.y",), default="d"), N.FieldRule("b", constant="k"), N.FieldRule("c", computed=F.col("id") * 2, kind="int")]
    df = spark.createDataFrame([(1, '{"x": null, "y": "Y"}'), (2, '{"y": "Y"}'), (3, "{}"), (4, "bad{")], "id int, doc string")
    out = {r.id: (r.a, r.b, r.c) for r in N.normalize_table(df, rules, "source", "doc", ["id"]).collect()}
    assert out == {1: (None, "k", "2"), 2: ("Y", "k", "4"), 3: ("d", "k", "6"), 4: ("d", "k", "8")}


def test_reconcile_properties(spark, sf):
    a, b = orders(spark, sf), orders_copy(spark, sf)
    assert reconcile.reconcile(a, a, ["k"], ORDER_RULES).count() == 0
    there = {r.diff_type: r.n for r in reconcile.diff_counts(reconcile.reconcile(a, b, ["k"], ORDER_RULES)).collect()}
    back = {r.diff_type: r.n for r in reconcile.diff_counts(reconcile.reconcile(b, a, ["k"], ORDER_RULES)).collect()}
    assert there["ORDER_TARGET_MISSING"] == back["ORDER_TARGET_EXTRA"] and there["ORDER_TARGET_EXTRA"] == back["ORDER_TARGET_MISSING"]
    assert there["ORDER_TARGET_DUPLICATE"] == back["SOURCE_BUSINESS_KEY_DUPLICATE"]
    acc = reconcile.field_accuracy(reconcile.matched_rows(a, b, ["k"], ORDER_RULES), ORDER_RULES).collect()
    assert all(r.checked_count == r.matched_count + r.mismatched_count for r in acc)
    assert reconcile.reconcile(a.limit(0), b.limit(0), ["k"], ORDER_RULES).count() == 0


def test_required_and_unreadable_values(spark):
    rules = [N.FieldRule("v", kind="int", required=True), N.FieldRule("w", ignore_if_source_missing=True)]
    a = spark.createDataFrame([(1, "x", None), (2, None, "a"), (3, "3", "b")], "k int, v string, w string")
    b = spark.createDataFrame([(1, "1", "z"), (2, "2", "a"), (3, "3.0", "c")], "k int, v string, w string")
    out = {(r.business_key, r.field, r.diff_type) for r in reconcile.reconcile(a, b, ["k"], rules).collect()}
    assert out == {("1", "v", "ORDER_NORMALIZE_ERROR"), ("1", "w", "ORDER_FIELD_MISMATCH"), ("2", "v", "ORDER_REQUIRED_SOURCE_VALUE_MISSING"), ("3", "w", "ORDER_FIELD_MISMATCH")}
    blocking = {r.diff_type for r in reconcile.classify_diffs(reconcile.reconcile(a, b, ["k"], rules)).where("blocking").collect()}
    assert blocking == {"ORDER_NORMALIZE_ERROR", "ORDER_REQUIRED_SOURCE_VALUE_MISSING"}


def test_details_by_key_and_place(spark):
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (1, "y", "2"), (2, "z", "5")], "p int, key string, v string")
    b = spark.createDataFrame([(1, "x", "9"), (1, "y", "2"), (1, "q", "7")], "p int, key string, v string")
    kinds = sorted((r.diff_type, r.business_key) for r in ingestion.compare_details(a, b, ["p"], ["key"], [N.FieldRule("v")]).collect())
    assert kinds == [("DETAIL_FIELD_MISMATCH", "1|x"), ("DETAIL_SOURCE_KEY_DUPLICATE", "1|y"), ("DETAIL_TARGET_EXTRA", "1|q"), ("DETAIL_TARGET_MISSING", "2|z")]
    placed = ingestion.compare_details(a, b, ["p"], None, [N.FieldRule("v")], order_by=["key"]).collect()
    assert {(r.business_key, r.expected, r.actual) for r in placed} == {("1|1", "1", "7"), ("1|2", "2", "9")}


def test_keep_fullest_is_idempotent(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}", "x" * (i % 5)) for i in range(100)], "id int, key string, body string")
    first = dedupe.keep_fullest(df, ["key"], F.length("body"), ["id"]).drop("n_copies")
    again = dedupe.keep_fullest(first, ["key"], F.length("body"), ["id"]).drop("n_copies")
    assert sorted(first.collect()) == sorted(again.collect()) and first.count() == 7


def test_statement_classes(spark):
    rows = [(1, "a", "select 1"), (2, "a", "select 1"), (3, "b", "SELECT 2;"), (4, "b", "select  2"), (5, "c", "x"), (6, "c", "y"), (7, "d", "z"), (8, "e", "z"), (9, "f", "w")]
    out = {r.id: r["class"] for r in dedupe.dedupe_statements(spark.createDataFrame(rows, "id int, title string, text string"), "title", "text").collect()}
    assert out == {1: "exact_duplicate", 2: "exact_duplicate", 3: "format_duplicate", 4: "format_duplicate", 5: "title_variant", 6: "title_variant", 7: "retitled", 8: "retitled", 9: "unique"}


def test_generated_rows_are_reproducible_and_legal(spark):
    rules = {"a": {"type": "int_range", "min": 5, "max": 9}, "b": {"type": "decimal_range", "min": 0.8, "max": 5}, "c": {"type": "uuid"}}
    x = datagen.generate_rows(spark, 500, rules)
    assert sorted(x.collect()) == sorted(datagen.generate_rows(spark, 500, rules).repartition(7).collect())
    assert datagen.check_legality(x, "row_index", {"a": {"nullable": False, "min": 5, "max": 9}, "b": {"type": "decimal(10,2)", "min": 0.8, "max": 5}, "c": {"max_length": 36}}, unique=["c"]).count() == 0
    f = datagen.funnel_metrics(x)
    assert f.where("impressions < clicks or clicks < orders or cost > gmv").count() == 0


def test_redaction(spark):
    doc = '{"user": "a", "access_token": "abcdef", "nested": {"password": "p\\"w", "token_count": 3}, "url": "http://x/?token=zzz&a=1"}'
    r = one(spark, R.redact_json(F.lit(doc)), R.redact_text(F.lit("Authorization: Bearer abcdefghijklmnop.q")))
    assert "abcdef" not in r.c0 and 'p\\"w' not in r.c0 and '"token_count":3' in r.c0 and "zzz" not in r.c0 and '"user":"a"' in r.c0
    assert r.c1 == "Authorization: Bearer <redacted>"


def test_unclosed_and_stray_tags(spark):
    html = "<p>one<p>two</p></div><b>three &amp; <i>four</i><script>if (a</p>b) {}</script></b><br><span hidden>no</span>"
    nodes = pages.page_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.tag, r.parent_id) for r in sorted(nodes, key=lambda r: r.node_id)] == [("p", -1), ("p", 0), ("b", 0), ("i", 2), ("script", 2), ("br", 0), ("span", 0)]
    assert next(r.text for r in nodes if r.tag == "b") == "three & four"
    assert next(r.hidden for r in nodes if r.tag == "span") and next(r.text for r in nodes if r.node_id == 0).startswith("one two three & four")


def test_dynamic_ids_and_generic_classes(spark):
    r = one(spark, locators.is_dynamic_id(F.lit("el-id-12-3")), locators.is_dynamic_id(F.lit("save")), locators.is_generic_class(F.lit("el-button is-link")), locators.is_generic_class(F.lit("el-button save")))
    assert tuple(r) == (True, False, True, False)


def test_paging(spark):
    read = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 2, 1), (9, 2, 2)], "k int, page int, position int")
    again = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (9, 2, 2)], "k int, page int, position int")
    out = {tuple(r) for r in responses.paging_check(read, spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k", again).collect()}
    assert out == {(2, "repeated"), (3, "never_returned"), (9, "unexpected"), (1, "unstable_order")}


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, category string")
    for kind in ("parquet", "json"):
        tables.write_result(df, str(tmp_path / kind), kind, by=["category"])
        assert sorted(r.id for r in tables.read_source(spark, tables.SourceSpec(kind, str(tmp_path / kind), id_column="id")).collect()) == [1, 2]


def test_append_rows(spark):
    rows = datagen.generate_rows(spark, 5, {"a": {"type": "sequence", "prefix": "T"}})
    spark.sql("DROP TABLE IF EXISTS appended_rows")
    tables.write_rows(rows, "appended_rows")
    tables.write_rows(rows, "appended_rows")
    assert spark.table("appended_rows").count() == 10
    spark.sql("DROP TABLE appended_rows")


def test_jdbc_options_take_the_password_from_the_environment(monkeypatch):
    monkeypatch.setenv("DB_PASSWORD", "pw")
    o = tables.jdbc_options("jdbc:postgresql://h/db", "t", "u", "DB_PASSWORD", "id", 0, 1000, 8)
    assert o["password"] == "pw" and o["driver"] == "org.postgresql.Driver" and o["numPartitions"] == "8"


def test_repeated_source_columns_are_taken_once(spark, sf):
    spec = tables.SourceSpec("parquet", f"{sf}/nation.parquet", id_column="n_nationkey", extra=(("n_name", "name"), ("n_regionkey", "NAME")), order_by=("n_nationkey",), limit=3)
    assert [tuple(r) for r in tables.read_source(spark, spec).collect()] == [(0, "NATION_0"), (1, "NATION_1"), (2, "NATION_2")]


def test_entry_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "concord", tmp_path / "concord", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, pipeline, known = out.stdout.split()
    assert int(n) > 100 and pipeline == "False" and known == "True", out.stderr


def test_json_paths_go_to_the_bottom(spark):
    df = spark.createDataFrame([('{"a": {"b": {"c": {"d": [{"e": 1}]}}}, "s": "[[\\\\\\"[{{{{{{{{"}',), ("[1]",), ("{{{{{{{{",), (None,)], "doc string")
    got = {(r.path, r.kind): r.n for r in ingestion.json_paths(df, "doc").collect()}
    assert got["$.a.b.c.d[*].e", "BIGINT"] == 1 and got["$.s", "STRING"] == 1 and got["$[*]", "BIGINT"] == 1 and len(got) == 10
    assert ingestion.json_paths(df.limit(0), "doc").count() == 0


def test_null_keys_equal_each_other(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert reconcile.reconcile(df, df, ["k"], [N.FieldRule("v")]).count() == 0
    out = reconcile.reconcile(df, df.where("k = 1"), ["k"], [N.FieldRule("v")]).collect()
    assert [(r.diff_type, r.business_key) for r in out] == [("ORDER_TARGET_MISSING", "<NULL>")] and len(out[0]) == 16


def test_values_emptied_by_intent_are_no_errors(spark):
    rules = [N.FieldRule("a", kind="int", empty_as_null=True), N.FieldRule("b", kind="int", source_transforms=("zero_to_null",), target_transforms=("zero_to_null",)), N.FieldRule("c", kind="decimal", source_transforms=("cents_to_decimal",))]
    a = spark.createDataFrame([(1, "", "0", "150"), (2, "x", "0", "?")], "k int, a string, b string, c string")
    b = spark.createDataFrame([(1, None, "0.0", "1.5"), (2, None, None, "1.5")], "k int, a string, b string, c string")
    assert {(r.business_key, r.field, r.diff_type) for r in reconcile.reconcile(a, b, ["k"], rules).collect()} == {("2", "a", "ORDER_NORMALIZE_ERROR"), ("2", "c", "ORDER_NORMALIZE_ERROR")}


def test_details_of_documents(spark):
    docs = spark.createDataFrame([("1", '{"no": "A", "d": [{"s": "x", "q": 1}, {"q": 2}, {"s": "y", "q": "z"}]}'), ("2", '{"no": "B", "d": [{"s": "x"}]}'), ("3", '{"no": null}'), ("4", '{"no": "C", "d": null}')], "id string, doc string")
    header = spark.createDataFrame([("A", 1), ("C", 3)], "no string, hid int")
    detail = spark.createDataFrame([(1, "x", 1), (1, "y", 5), (3, "w", 1), (9, "v", 0)], "fk int, s string, q int")
    spec = ingestion.DocumentSpec("id", "doc", (N.FieldRule("no", json_path="$.no", required=True),), (), "hid", "$.d", True, "fk", (N.FieldRule("s", json_path="$.s"),), (N.FieldRule("q", json_path="$.q", kind="int"), N.FieldRule("gone", json_path="$.q")))
    got = sorted((r.diff_type, r.source_id or "", r.detail_key or "") for r in ingestion.verify_ingestion(docs, header, detail, spec).collect())
    assert got == sorted([("DETAIL_COUNT_MISMATCH", "1", ""), ("DETAIL_COUNT_MISMATCH", "4", ""), ("DETAIL_ARRAY_MISSING", "4", ""), ("DETAIL_SOURCE_KEY_MISSING", "1", "<NULL>"), ("DETAIL_TARGET_MISSING", "1", "<NULL>"), ("DETAIL_TARGET_COLUMN_MISSING", "1", "x"), ("DETAIL_TARGET_COLUMN_MISSING", "1", "y"), ("DETAIL_NORMALIZE_ERROR", "1", "y"), ("DETAIL_TARGET_EXTRA", "4", "w"), ("ORDER_TARGET_MISSING", "2", ""), ("ORDER_SOURCE_KEY_MISSING", "3", ""), ("ORPHAN_DETAIL", "", "v")])


def test_deeply_nested_secrets_hide_the_document(spark):
    r = one(spark, R.redact_json(F.lit('{"a": 1, "secret": [[[[["x"]]]]]}')), R.redact_json(F.lit('{"account_password": "x y", "n": [{"token": null}]}')))
    assert r.c0 == '"<redacted>"' and r.c1 == '{"account_password":"<redacted>","n":[{"token":"<redacted>"}]}'


def test_too_few_reference_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert dedupe.reference_rows(df, ["a"], 2).count() == 2 and dedupe.reference_rows(df, ["a"], 5, distinct=False).count() == 5
    for call in (lambda: dedupe.reference_rows(df, ["a"], 3), lambda: dedupe.reference_rows(df.limit(0), ["a"], 1, distinct=False), lambda: dedupe.reference_rows(df, ["a"], 9, most=8)):
        with pytest.raises(ValueError):
            call()


def test_null_is_refused_where_it_may_not_be(spark):
    with pytest.raises(ValueError):
        datagen.generate_rows(spark, 3, {"a": {"type": "null"}}, required=("a",))
    rows, ref = spark.range(3).withColumnRenamed("id", "row_index"), spark.createDataFrame([(0, "x"), (1, None)], "row_index long, v string")
    assert datagen.attach_reference(rows, ref, {"w": "v"}).count() == 3
    with pytest.raises(Exception, match="w must not be null"):
        datagen.attach_reference(rows, ref, {"w": "v"}, required=("w",)).collect()


def test_inferred_rules_generate_rows(spark, sf):
    c = tables.column_catalog(spark, {"customer": spark.read.parquet(f"{sf}/customer.parquet")})
    rules = datagen.rules_of(datagen.infer_rule(c))
    assert rules["c_acctbal"]["type"] == "decimal_range" and rules["c_custkey"]["type"] == "int_range" and rules["c_mktsegment"]["type"] == "enum"
    rows = datagen.generate_rows(spark, 20, rules)
    assert rows.count() == 20 and rows.where("c_acctbal < 10 or c_acctbal > 9000 or c_name is null").count() == 0
    wide = datagen.generate_rows(spark, 200, {"a": {"type": "int_range", "min": 0, "max": 1 << 50}})
    assert wide.where("a > 4294967296").count() > 150


def test_grouped_differences_pass_through(spark):
    df = spark.createDataFrame([("f", "1", "a", "b", None, None), ("f", "2", "c", None, None, None), ("g", "", None, None, 7, "x=>y")], "field string, k string, expected string, actual string, n long, samples string")
    assert {tuple(r) for r in reconcile.group_differences(df, ["field"], ["k"], 1).collect()} == {("f", 2, "a=>b"), ("g", 7, "x=>y")}
    totals = spark.createDataFrame([("duplicate", 4), ("field", 9)], "grp string, n long")
    assert {tuple(r) for r in reconcile.difference_summary(spark.createDataFrame([("ORDER_FIELD_MISMATCH",)], "diff_type string"), totals).collect()} == {("source_only", 0), ("target_only", 0), ("duplicate", 4), ("field", 1)}


def test_reconcile_aggregates_keys_alone(spark):
    a = spark.createDataFrame([(1, "N", "1.00", "H"), (None, "N", "2.00", "H"), (2, "N", "3.00", "H"), (2, "N", "3.00", "L")], "k long, status string, price string, priority string")
    b = spark.createDataFrame([(1, "n", "1.00", "H"), (None, "N", "2.01", "H"), (2, "N", "3.00", "H"), (3, "N", "1.00", "H"), (3, "N", "1.00", "H")], a.schema)
    out = reconcile.reconcile(a, b, ["k"], ORDER_RULES)
    assert "SortAggregate" not in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.diff_type, r.business_key, r.field or "", r.n or 0) for r in out.collect()) == [
        ("ORDER_FIELD_MISMATCH", "1", "status", 0), ("ORDER_FIELD_MISMATCH", "2", "priority", 0), ("ORDER_FIELD_MISMATCH", "<NULL>", "price", 0),
        ("ORDER_TARGET_EXTRA", "3", "", 2), ("SOURCE_BUSINESS_KEY_DUPLICATE", "2", "", 1),
    ]
