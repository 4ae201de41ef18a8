"""Digest trees, keys, causes, profiles, selectors, repeatable writes and key pushdown against plain loops."""

import itertools
import json
import random

import duckdb

from concord.functions.normalize import FieldRule
from concord.operators import causes, chain, dedupe, digest_tree, ingestion, keys, locators, pages, profiles, reconcile, selectors
from concord.plans import ORACLE, QUERIES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_digest_tree_equals_reconcile(spark):
    rnd = random.Random(5)
    base = [(i, rnd.choice(["a", "b", None, ""]), str(rnd.randint(0, 9)), "x") for i in range(3000)]
    base += [base[7], base[7], (None, "n", "1", "x"), (4000, "a", "no number", "x"), (4001, "a", "1", None)]
    other = [(k, a, b, c) for k, a, b, c in base if k not in (5, 50, 500)]
    other = [(k, "changed" if k in (11, 12) else a, b if k != 13 else "77", c) for k, a, b, c in other] + [(5001, "new", "1", "x"), (17, "a", "2", "x")]
    rules = [FieldRule("s"), FieldRule("n", kind="int"), FieldRule("t", required=True)]
    source, target = (spark.createDataFrame(x, "sn long, s string, n string, t string") for x in (base, other))
    want = rows(reconcile.reconcile(source, target, ["sn"], rules))
    found = digest_tree.reconcile_by_digest(source, target, ["sn"], rules)
    assert rows(found.diffs) == want and len(want) >= 12
    for r in found.read_again().collect():
        assert r.n_rows < 0.2 * len(base)
    same = digest_tree.reconcile_by_digest(source.limit(0), target.limit(0), ["sn"], rules)
    assert same.diffs.count() == 0 and same.nodes.count() == 0


def test_digest_tree_reads_few_rows_again(spark):
    df = spark.range(50_000).selectExpr("id AS k", "id % 7 AS v")
    found = digest_tree.reconcile_by_digest(df, df.selectExpr("k", "CASE WHEN k % 1000 = 3 THEN 99 ELSE v END AS v"), ["k"], [FieldRule("v", kind="int")])
    assert found.diffs.count() == 50 and all(r.n_rows < 2500 for r in found.read_again().collect())


def brute_keys(table, names, most):
    found = []
    for size in range(1, most + 1):
        for c in itertools.combinations(range(len(names)), size):
            if not any(set(k) <= set(c) for k in found) and len({tuple(r[i] for i in c) for r in table}) == len(table):
                found.append(c)
    return sorted(",".join(names[i] for i in c) for c in found)


def test_find_keys_equals_all_combinations(spark):
    rnd, names = random.Random(2), ["a", "b", "c.d", "e", "f"]
    for spread in (2, 12, 400):
        table = [(i % 40, i // 40, rnd.randint(0, spread), rnd.choice([None, "", "x"]), f"{i % 40}-{rnd.randint(0, 1)}") for i in range(400)]
        df = spark.createDataFrame(table, "a int, b int, `c.d` int, e string, f string")
        assert sorted(r.key for r in keys.find_keys(df).collect()) == brute_keys(table, names, 3)
    assert keys.find_keys(df.union(df)).count() == 0 and keys.find_keys(df.limit(0)).count() == 0
    assert [r.key for r in keys.find_keys(df.select("a").distinct()).collect()] == ["a"]


def test_find_keys_by_samples_of_values(spark, monkeypatch):
    """No sketch decides, and few of the values are looked at: keys, near keys and columns of few values."""
    monkeypatch.setattr(keys.F, "approx_count_distinct", lambda *_: keys.F.lit(1))
    monkeypatch.setattr(keys, "SAMPLE", 1 << 11, raising=False)
    df = spark.range(20_000).selectExpr("id DIV 50 AS a", "id % 50 AS b", "IF(id = 7, 8, id) AS c", "id % 3 AS d", "IF(id = 0, NULL, id) AS e", "1 AS f")
    assert sorted(r.key for r in keys.find_keys(df).collect()) == ["a,b", "b,c", "c,d", "e"]


def test_find_keys_names_columns_as_given(spark, tmp_path):
    """As the SQL: the order of the list, not of the table; ``ts`` alone is a key of the given events only as long as no two users share one."""
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 5)], "event_id int, ts int, user_id int")
    assert [r.key for r in keys.find_keys(df, ["event_id", "user_id", "ts"]).collect()] == ["event_id", "user_id,ts"]
    spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(id DIV 2) AS ts", "id % 2 AS user_id", "'x' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).selectExpr("id AS o_orderkey", "id % 4 AS o_custkey", "'F' AS o_orderstatus", "id DIV 4 AS o_totalprice", "current_date AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id % 4 AS l_shipdate", "id DIV 4 AS l_linenumber", "1 AS l_partkey", "1 AS l_suppkey", "1 AS l_quantity", "1 AS l_extendedprice", "1 AS l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in QUERIES["find_keys"](spark, str(tmp_path)).collect()) == sorted(duck.execute(ORACLE["find_keys"]).fetchall())


def test_find_keys_by_all_rows_in_one_pass(spark, monkeypatch):
    """What the sample leaves open is decided without grouping the rows for each combination, unless a few hashes are equal; texts with a collation are grouped."""
    grouped = []
    monkeypatch.setattr(keys, "_repeats", lambda df, combo, old=keys._repeats: grouped.append(combo) or old(df, combo))
    monkeypatch.setattr(keys, "SHARE", 1 << 10, raising=False)
    monkeypatch.setattr(keys, "ROWS", 1 << 12, raising=False)
    df = spark.range(30_000).selectExpr("id DIV 50 AS a", "id % 50 AS b", "IF(id % 500 = 7, 0, id) AS c", "IF(id = 3, 4, id) AS d", "IF(id = 0, NULL, -id) AS e")
    assert sorted(r.key for r in keys.find_keys(df).collect()) == ["a,b", "b,d", "c,d", "e"]
    assert sorted(grouped) == [("a", "c"), ("a", "d"), ("d",)]
    texts = spark.range(4).selectExpr("collate(IF(id = 3, 'A', substr('abc', id + 1, 1)), 'UTF8_LCASE') AS t", "id AS u")
    assert [r.key for r in keys.find_keys(texts).collect()] == ["u"]


def test_causes_of_many_differences(spark):
    cells = [("s", "A", "1") for _ in range(30)] + [("s", "B", "B") for _ in range(30)] + [("s", "B", "2")] + [("p", str(i), str(i * 1000)) for i in range(1, 41)] + [("p", "5", "6") for _ in range(9)]
    cells += [("t", f"2024-03-01 10:{i:02}:00", f"2024-03-01 04:{i + 30:02}:00") for i in range(20)] + [("u", f"2024-03-01 10:{i:02}:00", f"2024-03-01 10:{i:02}:07") for i in range(20)] + [("q", str(i), f"z{i * i}") for i in range(30)] + [("w", None, None)] * 20
    found = {(r.field, r.cause, r.detail): (r.support, float(r.share), float(r.confidence)) for r in causes.systematic_causes(spark.createDataFrame(cells, "field string, expected string, actual string")).collect()}
    assert found == {("s", "value_map", "A=>1"): (30, 0.9677, 1.0), ("p", "unit_scale", "1000"): (40, 0.8163, 0.8163), ("t", "time_zone", "-05:30"): (20, 1.0, 1.0), ("u", "time_shift", "7"): (20, 1.0, 1.0)}


def test_profiles_of_batches_merge(spark):
    rnd = random.Random(4)
    table = [(b, rnd.choice(["new", "new", "new", "old", "", None]), str(rnd.randint(0, 5000)), "0") for b in range(3) for _ in range(900 * (b + 1))]
    df = spark.createDataFrame(table, "batch int, state string, id string, zero string")
    by_batch = profiles.profile_state(df, ["state", "id", "zero"], ["batch"])
    merged = {r.field: r for r in profiles.merge_profiles(by_batch.drop("batch")).collect()}
    whole = {r.field: r for r in profiles.merge_profiles(profiles.profile_state(df, ["state", "id", "zero"])).collect()}
    for f, r in merged.items():
        assert (r.n_rows, r.n_null, r.n_empty, r.n_zero, r.label, r.default_value, r.n_default) == tuple(whole[f][c] for c in ("n_rows", "n_null", "n_empty", "n_zero", "label", "default_value", "n_default"))
        exact = len({x[{"state": 1, "id": 2, "zero": 3}[f]] for x in table} - {None})
        assert abs(r.n_distinct - exact) <= 0.05 * exact
    assert (merged["state"].default_value, merged["state"].n_default, merged["state"].label) == ("new", sum(x[1] == "new" for x in table), "business")
    assert merged["zero"].label == "all_zero" and merged["id"].default_value is None


HTML = """<html><body><div id="box" class="a b"><button class="btn">x</button><button class="btn big">y</button><p class="btn">z</p>
<div id="in"><button class="big btn">w</button><span class="one">1</span></div></div><div class="b a c"><span class="one two">2</span></div>
<button class="btn-3 el-button is-active last">v</button><div id="box"><i class="two"></i></div></body></html>"""


def brute_matches(nodes, container, tag, classes):
    up = {n.node_id: n.parent_id for n in nodes}
    attr = {n.node_id: n.attrs or {} for n in nodes}
    found = []
    for n in nodes:
        above, at = [], up[n.node_id]
        while at != -1:
            above.append(at)
            at = up[at]
        if n.tag == tag and set(classes) <= set(attr[n.node_id].get("class", "").split()) and (container is None or any(attr[x].get("id") == container for x in above)):
            found.append(n.node_id)
    return found


def test_selectors_equal_a_plain_matcher(spark):
    nodes = pages.page_nodes(spark.createDataFrame([(1, HTML), (2, HTML.replace("btn", "b")), (3, ""), (4, None)], "page_id long, html string")).cache()
    by_page = {p: [n for n in nodes.collect() if n.page_id == p] for p in (1, 2)}
    asked = [(p, c, t, k) for p in (1, 2) for c in (None, "box", "in", "gone") for t in ("button", "div", "span", "i", "p") for k in ([], ["btn"], ["btn", "big"], ["a", "b"], ["one"], ["two", "one"], ["nowhere"])]
    table = spark.createDataFrame([(str(i), *x) for i, x in enumerate(asked)], "selector string, page_id long, container string, tag string, classes array<string>")
    got = {}
    for r in selectors.matches(table, nodes).collect():
        got.setdefault(int(r.selector), []).append(r.node_id)
    assert {i: sorted(v) for i, v in got.items()} == {i: f for i, (p, *x) in enumerate(asked) if (f := brute_matches(by_page[p], *x))}
    elements = locators.page_elements(nodes)
    for r in locators.locator_candidates(elements, elements).where("strategy in ('class', 'scoped')").collect():
        value, container = r.value, None
        if r.strategy == "scoped":
            container, value = r.value[1:].split(" ", 1)
        tag, *classes = value.split(".")
        assert r.unique == (brute_matches(by_page[r.page_id], container, tag, classes) == [r.node_id]), r


def test_intervals_hold_descendants(spark):
    for n in pages.page_nodes(spark.createDataFrame([(1, HTML + "<ul><li>a<li>b</ul><br>")], "page_id long, html string")).collect():
        assert n.last_id >= n.node_id and n.xpath.count("/") == n.depth + 1 and n.xpath.endswith(f"/{n.tag}[{n.nth}]")


def test_documents_of_five_hundred_levels(spark):
    deep = "1"
    for _ in range(500):
        deep = '{"a":' + deep + "}"
    docs = [deep, '{"a": [1, 2.5, 1e3, 12345678901234567890, {"b": null}, "x", true]}', '{"a": 1, "a": 2}', "[NaN]", "{", None]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {(r.path, r.kind): r.n for r in ingestion.json_paths(df, "doc").collect()}
    assert got["$" + ".a" * 500, "BIGINT"] == 1 and got["$.a", "OBJECT"] == 1 and got["$.a", "ARRAY"] == 1 and got["$.a[*]", "DECIMAL"] == 2 and got["$.a[*]", "DOUBLE"] == 1 and got["$.a[*].b", "VOID"] == 1 and got["$", "OBJECT"] == 2 and ("$", "ARRAY") not in got
    assert len(ingestion.json_paths(df, "doc", depth=2).collect()) == 3


def test_documents_with_one_id_are_rows_of_their_own(spark):
    doc = json.dumps({"no": "A", "d": [{"s": "x"}, {"s": "y"}]})
    docs = spark.createDataFrame([(1, doc, "7"), (1, doc, "7"), (1, json.dumps({"no": "B", "d": []}), "8"), (2, '{"no": " "}', "9"), (3, '{"no": null}', "9"), (4, "{}", "9")], "id int, doc string, ref string")
    header, detail = spark.createDataFrame([("A", 70), ("B", 80)], "no string, hid int"), spark.createDataFrame([(7, "x"), (7, "z")], "fk int, s string")
    key = (FieldRule("no", json_path="$.no"),)
    spec = ingestion.DocumentSpec("id", "doc", key, (), "hid", "$.d", False, "fk", (FieldRule("s", json_path="$.s"),), detail_source_fk="ref")
    got = sorted((r.diff_type, r.source_id or "", r.detail_key or "") for r in ingestion.verify_ingestion(docs, header, detail, spec).collect() if r.diff_type != "ORPHAN_DETAIL")
    assert got == sorted([("DETAIL_TARGET_MISSING", "1", "y")] * 2 + [("DETAIL_TARGET_EXTRA", "1", "z")] * 2 + [("SOURCE_BUSINESS_KEY_DUPLICATE", "", "")] + [("ORDER_SOURCE_KEY_MISSING", str(i), "") for i in (2, 3, 4)])
    lost = ingestion.verify_ingestion(docs.drop("ref"), header, detail, spec)
    assert lost.where("diff_type = 'DETAIL_FETCH_ERROR'").count() == 3
    summary, diffs = ingestion.ingestion_summary(docs, header, detail, spec)
    assert tuple(summary.first()) == (6, 6, 3, 4, diffs.count())


def test_equal_documents_that_refer_to_different_details(spark):
    """Each document meets the details that it refers to; whole documents and lines are dealt out once."""
    doc = json.dumps({"no": "A", "d": [{"s": "x"}]})
    docs = spark.createDataFrame([(1, doc, "7"), (1, doc, "9"), (1, doc, None)], "id int, doc string, ref string")
    header, detail = spark.createDataFrame([("A", 70)], "no string, hid int"), spark.createDataFrame([(7, "x")], "fk int, s string")
    spec = ingestion.DocumentSpec("id", "doc", (FieldRule("no", json_path="$.no"),), (), "hid", "$.d", False, "fk", (FieldRule("s", json_path="$.s"),), detail_source_fk="ref")
    diffs = ingestion.verify_ingestion(docs, header, detail, spec).where("scope = 'detail' and diff_type <> 'ORPHAN_DETAIL'")
    assert sorted(r.diff_type for r in diffs.collect()) == ["DETAIL_COUNT_MISMATCH"] * 2 + ["DETAIL_TARGET_MISSING"] * 2


def test_relations_count_once(spark):
    ids = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (3, 30), (3, 31)], "old_id int, new_id int")
    source = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 9), ("d", 1), ("e", None), ("m", 3)], "c string, p int")
    target = spark.createDataFrame([("a", 10), ("a", 10), ("b", 10), ("c", 1), ("e", None), ("x", 5), ("m", 30), ("m", 31)], "c string, p int")
    assert rows(chain.check_relations(source, ids, target, "c", "p")) == [("b", "different"), ("c", "unmapped"), ("d", "missing"), ("x", "extra")]


def test_keys_of_any_name(spark):
    for names in (["s", "t"], ["sn", "tn"], ["_key1", "_right__key0"], ["v", "f"]):
        df = spark.createDataFrame([(1, 2, "a"), (1, 3, "b")], f"`{names[0]}` int, `{names[1]}` int, w string")
        out = reconcile.reconcile(df, df.withColumn("w", df.w.substr(1, 0)), names, [FieldRule("w"), FieldRule(names[0], kind="int")])
        assert rows(out.select("business_key", "field", "expected", "actual")) == [("1|2", "w", "a", ""), ("1|3", "w", "b", "")]


def test_names_of_many_rows_are_numbered_alike(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}" if i % 4 else None) for i in range(200)], "o int, name string")
    assert rows(dedupe.suffix_duplicates(df, "name", ["o"])) == rows(dedupe.suffix_duplicates(df, "name", ["o"], most=40)) == rows(dedupe.suffix_duplicates(df, "name", ["o"], most=0))
