"""Reconciliation, ingestion, coverage, chains, deduplication and mapping over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import redact as R
from ..operators import chain, coverage, dedupe, ingestion, reconcile, schema_match
from .fixtures import DIFFS_SQL, LINES_SQL, MATCHED_SQL, ORDER_RULES, ORDERS_SQL, lineitem, lineitem_copy, orders, orders_copy, orders_json, spread, table
from .registry import query

KEYS = ["k"]


def _diffs(spark, sf_dir) -> DataFrame:
    return reconcile.reconcile(orders(spark, sf_dir), orders_copy(spark, sf_dir), KEYS, ORDER_RULES)


def _joined(spark, sf_dir) -> DataFrame:
    return reconcile.matched_rows(orders(spark, sf_dir), orders_copy(spark, sf_dir), KEYS, ORDER_RULES)


# ---- reconciliation ------------------------------------------------------------------------------

@query(f"WITH {DIFFS_SQL} SELECT diff_type, CAST(key AS VARCHAR) AS business_key, field, expected, actual FROM d")
def reconcile_orders(spark, sf_dir):
    return _diffs(spark, sf_dir).select("diff_type", "business_key", "field", "expected", "actual")


@query(f"WITH {DIFFS_SQL} SELECT diff_type, count(*) AS n FROM d GROUP BY 1")
def diff_counts(spark, sf_dir):
    return reconcile.diff_counts(_diffs(spark, sf_dir))


@query(f"WITH {DIFFS_SQL} SELECT CASE WHEN diff_type = 'ORDER_TARGET_DUPLICATE' THEN 'relationship' ELSE 'order' END AS category, false AS blocking, count(*) AS n FROM d GROUP BY 1, 2")
def classify_diffs(spark, sf_dir):
    return reconcile.classify_diffs(_diffs(spark, sf_dir)).groupBy("category", "blocking").agg(F.count("*").alias("n"))


@query(f"WITH {ORDERS_SQL}, h AS (SELECT k, count(*) AS n FROM oc GROUP BY k) SELECT CASE WHEN h.n IS NULL THEN 'missing' WHEN h.n = 1 THEN 'comparable' ELSE 'duplicate' END AS outcome, count(*) AS n FROM ob LEFT JOIN h USING (k) GROUP BY 1")
def match_target(spark, sf_dir):
    return reconcile.match_target(orders(spark, sf_dir), orders_copy(spark, sf_dir), KEYS).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {ORDERS_SQL} SELECT k, count(*) AS n FROM oc GROUP BY k HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return reconcile.duplicate_keys(orders_copy(spark, sf_dir), KEYS)


@query(f"WITH {ORDERS_SQL} SELECT 'source' AS side, count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM ob UNION ALL SELECT 'target', count(*), count(DISTINCT k) FROM oc")
def totals(spark, sf_dir):
    return reconcile.totals(orders(spark, sf_dir), orders_copy(spark, sf_dir), KEYS)


@query(f"WITH {LINES_SQL} SELECT 'lk' AS candidate, count(*) AS n_rows, count(DISTINCT lk) AS n_distinct, count(*) = count(DISTINCT lk) AS is_unique FROM li UNION ALL SELECT 'lk,ln', count(*), count(DISTINCT (lk, ln)), count(*) = count(DISTINCT (lk, ln)) FROM li UNION ALL SELECT 'lk,ln,part,ext', count(*), count(DISTINCT (lk, ln, part, ext)), count(*) = count(DISTINCT (lk, ln, part, ext)) FROM li")
def key_uniqueness(spark, sf_dir):
    return reconcile.key_uniqueness(lineitem(spark, sf_dir), [["lk"], ["lk", "ln"], ["lk", "ln", "part", "ext"]])


_ACCURACY = f"WITH {MATCHED_SQL}" + " SELECT 'status' AS target_field, 'status' AS category, count(*) AS checked_count, count(*) FILTER (s1 IS NOT DISTINCT FROM t1) AS matched_count, count(*) FILTER (s1 IS DISTINCT FROM t1) AS mismatched_count, '{worst}' AS status FROM m UNION ALL SELECT 'price', 'amount', count(*), count(*) FILTER (s2 IS NOT DISTINCT FROM t2), count(*) FILTER (s2 IS DISTINCT FROM t2), '{worst}' FROM m UNION ALL SELECT 'priority', 'business', count(*), count(*) FILTER (s3 IS NOT DISTINCT FROM t3), count(*) FILTER (s3 IS DISTINCT FROM t3), 'WARN' FROM m"


@query(_ACCURACY.replace("{worst}", "WARN"))
def field_accuracy(spark, sf_dir):
    return reconcile.field_accuracy(_joined(spark, sf_dir), ORDER_RULES)


@query(_ACCURACY.replace("{worst}", "FAIL"))
def zero_tolerance(spark, sf_dir):
    return reconcile.apply_zero_tolerance(reconcile.field_accuracy(_joined(spark, sf_dir), ORDER_RULES))


@query(f"WITH {DIFFS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY CAST(key AS VARCHAR)) AS rn FROM d WHERE field IS NOT NULL), g AS (SELECT field, count(*) AS n FROM r GROUP BY field) SELECT g.field, g.n, (SELECT string_agg(coalesce(expected, '<NULL>') || '=>' || coalesce(actual, '<NULL>'), '; ' ORDER BY rn) FROM r WHERE r.field = g.field AND rn <= 3) AS samples FROM g")
def group_differences(spark, sf_dir):
    return reconcile.group_differences(_diffs(spark, sf_dir).where("field is not null"), ["field"], ["business_key"])


@query(f"WITH {DIFFS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY diff_type ORDER BY CAST(key AS VARCHAR), field) AS rn FROM d) SELECT diff_type, CAST(key AS VARCHAR) AS business_key, field FROM r WHERE rn <= 5")
def sample_diffs(spark, sf_dir):
    return reconcile.sample_diffs(_diffs(spark, sf_dir), ["business_key", "field"], 5, by=["diff_type"]).select("diff_type", "business_key", "field")


@query(f"WITH {DIFFS_SQL}, g AS (SELECT CASE diff_type WHEN 'ORDER_TARGET_MISSING' THEN 'source_only' WHEN 'ORDER_TARGET_EXTRA' THEN 'target_only' WHEN 'ORDER_TARGET_DUPLICATE' THEN 'duplicate' ELSE 'field' END AS grp FROM d) SELECT grp, count(*) AS n FROM g GROUP BY grp")
def difference_summary(spark, sf_dir):
    return reconcile.difference_summary(_diffs(spark, sf_dir))


_LOOSE = [N.FieldRule("status", source_transforms=(F.lower,), target_transforms=(F.lower,)), N.FieldRule("price", kind="decimal", scale=1), N.FieldRule("priority")]


@query(f"WITH {MATCHED_SQL} SELECT 'status' AS field, count(*) FILTER (s1 IS DISTINCT FROM t1) AS strict, count(*) FILTER (lower(s1) IS DISTINCT FROM lower(t1)) AS normalized, count(*) FILTER (s1 IS DISTINCT FROM t1 AND lower(s1) IS NOT DISTINCT FROM lower(t1)) AS observations FROM m UNION ALL SELECT 'price', count(*) FILTER (s2 <> t2), count(*) FILTER (round(s2, 1) <> round(t2, 1)), count(*) FILTER (s2 <> t2 AND round(s2, 1) = round(t2, 1)) FROM m UNION ALL SELECT 'priority', count(*) FILTER (s3 IS DISTINCT FROM t3), count(*) FILTER (s3 IS DISTINCT FROM t3), 0 FROM m")
def strict_vs_normalized(spark, sf_dir):
    joined = reconcile.matched_rows(orders(spark, sf_dir), orders_copy(spark, sf_dir), KEYS, _LOOSE)
    return reconcile.strict_vs_normalized(joined, _LOOSE)


@query(f"WITH {DIFFS_SQL} SELECT field, CASE field WHEN 'status' THEN 'whitespace_case' WHEN 'price' THEN 'rounding' ELSE 'null_or_sentinel' END AS cause, count(*) AS n FROM d WHERE field IS NOT NULL GROUP BY 1, 2")
def tag_causes(spark, sf_dir):
    found = reconcile.tag_causes(_diffs(spark, sf_dir).where("field is not null"))
    return found.groupBy("field", "cause").agg(F.count("*").alias("n"))


@query(f"WITH {MATCHED_SQL}, v AS (SELECT 'exact' AS policy, count(*) FILTER (s2 <> t2) AS mismatched FROM m UNION ALL SELECT 'scale_0', count(*) FILTER (round(s2, 0) <> round(t2, 0)) FROM m UNION ALL SELECT 'scale_1', count(*) FILTER (round(s2, 1) <> round(t2, 1)) FROM m) SELECT policy, mismatched, CASE WHEN mismatched = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v")
def verdict_by_policy(spark, sf_dir):
    return reconcile.verdict_by_policy(_joined(spark, sf_dir), 1, [0, 1])


@query("SELECT 'o_orderdate' AS field, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest FROM orders")
def time_evidence(spark, sf_dir):
    return reconcile.time_evidence(table(spark, sf_dir, "orders"), ["o_orderdate"])


@query(f"WITH {ORDERS_SQL}, a AS (SELECT k, status, price FROM ob EXCEPT ALL SELECT k, status, price FROM oc), b AS (SELECT k, status, price FROM oc EXCEPT ALL SELECT k, status, price FROM ob) SELECT *, 'left' AS side FROM a UNION ALL SELECT *, 'right' FROM b")
def except_both(spark, sf_dir):
    return reconcile.except_both(*(df.select("k", "status", "price") for df in (orders(spark, sf_dir), orders_copy(spark, sf_dir))))


@query(f"WITH {ORDERS_SQL} SELECT 'priority' AS field, count(*) AS n_rows, count(*) FILTER (priority IS NULL) AS n_null, 0 AS n_empty, 0 AS n_zero, count(*) FILTER (priority = '5-LOW') AS n_default, 'business' AS label FROM oc UNION ALL SELECT 'cust', count(*), 0, 0, count(*) FILTER (cust = 0), 0, 'business' FROM oc")
def value_profile(spark, sf_dir):
    return reconcile.value_profile(orders_copy(spark, sf_dir), ["priority", "cust"], {"priority": "5-LOW"})


@query("SELECT o_orderkey AS k, 'urgent_is_open' AS rule FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'dear_has_customer' FROM orders WHERE o_totalprice > 400000 AND o_custkey % 2 = 0")
def check_conditional(spark, sf_dir):
    rules = [("urgent_is_open", F.col("priority") == "1-URGENT", F.col("status") == "O"), ("dear_has_customer", F.col("price") > 400000, F.col("cust") % 2 == 1)]
    return reconcile.check_conditional(orders(spark, sf_dir), rules, KEYS)


@query("SELECT count(*) AS n, sum(o_orderkey) AS total FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50)")
def scoped_smoke(spark, sf_dir):
    first = reconcile.smoke(reconcile.scope(orders(spark, sf_dir), "status = 'F'"), KEYS, 50)
    return first.agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# ---- ingestion ---------------------------------------------------------------------------------------

_DOC = "CASE WHEN k % 211 = 0 THEN 'SOURCE_JSON_INVALID' WHEN k % 223 = 0 THEN 'SOURCE_JSON_NOT_OBJECT' ELSE 'ok' END"


@query(f"WITH {ORDERS_SQL} SELECT k AS id, {_DOC} AS json_status FROM ob")
def check_json(spark, sf_dir):
    return ingestion.check_json(orders_json(spark, sf_dir), "doc", ["id"])


@query(f"WITH {ORDERS_SQL} SELECT k AS id, '$.orderNo' AS part, 'missing' AS problem FROM ob WHERE {_DOC} = 'ok' AND k % 227 = 0 UNION ALL SELECT k, '$.status', 'unreadable' FROM ob WHERE {_DOC} = 'ok'")
def check_keys(spark, sf_dir):
    return ingestion.check_keys(orders_json(spark, sf_dir), "doc", {"$.orderNo": "int", "$.status": "int"}, ["id"])


@query(f"WITH {ORDERS_SQL}, {LINES_SQL}, n AS (SELECT lk, count(*) AS n FROM li GROUP BY lk) SELECT k AS id, CASE WHEN k % 229 = 0 THEN 'DETAIL_ARRAY_NOT_LIST' ELSE 'ok' END AS status, CASE WHEN k % 229 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_items FROM ob LEFT JOIN n ON lk = k WHERE {_DOC} = 'ok'")
def detail_array_status(spark, sf_dir):
    return ingestion.detail_array_status(ingestion.parse_documents(orders_json(spark, sf_dir), "doc"), "doc", "$.details", ["id"])


_ITEMS = {"ln": ("$.line", "int"), "part": ("$.part", "int"), "qty": ("$.qty", "decimal"), "ext": ("$.ext", "decimal")}


def _items(spark, sf_dir):
    return ingestion.project_items(ingestion.explode_details(orders_json(spark, sf_dir), "doc", "$.details", ["id"]), _ITEMS, [F.col("id").alias("lk")])


_GOOD = "lk % 211 <> 0 AND lk % 223 <> 0 AND lk % 229 <> 0 AND lk IN (SELECT o_orderkey FROM orders)"


@query(f"WITH {LINES_SQL} SELECT lk, CAST(ln AS VARCHAR) AS ln, CAST(part AS VARCHAR) AS part, CAST(qty AS VARCHAR) AS qty, CAST(ext AS VARCHAR) AS ext FROM li WHERE {_GOOD}")
def explode_details(spark, sf_dir):
    return _items(spark, sf_dir)


_DETAIL_RULES = [N.FieldRule("part", kind="int"), N.FieldRule("qty", kind="decimal"), N.FieldRule("ext", kind="decimal")]


@query(f"""WITH {LINES_SQL}, s AS (SELECT lk, ln, count(*) AS n, min((part, qty, ext)) AS v FROM li WHERE {_GOOD} GROUP BY 1, 2), t AS (SELECT lk, ln, count(*) AS n, min((part, qty, ext)) AS v FROM lc WHERE {_GOOD} GROUP BY 1, 2),
    b AS (SELECT coalesce(s.lk, t.lk) AS lk, coalesce(s.ln, t.ln) AS ln, s.n AS sn, t.n AS tn, s.v AS sv, t.v AS tv FROM s FULL JOIN t ON s.lk = t.lk AND s.ln = t.ln),
    d AS (SELECT 'DETAIL_TARGET_MISSING' AS diff_type, lk, ln FROM b WHERE tn IS NULL UNION ALL SELECT 'DETAIL_SOURCE_KEY_DUPLICATE', lk, ln FROM b WHERE sn > 1 UNION ALL SELECT 'DETAIL_TARGET_KEY_DUPLICATE', lk, ln FROM b WHERE tn > 1 UNION ALL SELECT 'DETAIL_FIELD_MISMATCH', lk, ln FROM b WHERE sn = 1 AND tn = 1 AND sv <> tv)
    SELECT diff_type, lk || '|' || ln AS business_key FROM d""")
def compare_details(spark, sf_dir):
    good = "lk % 211 <> 0 AND lk % 223 <> 0 AND lk % 229 <> 0"
    target = lineitem_copy(spark, sf_dir).where(good).join(orders(spark, sf_dir).select(F.col("k").alias("lk")), "lk", "left_semi")
    source = _items(spark, sf_dir).withColumn("ln", F.col("ln").cast("int"))
    return ingestion.compare_details(source, target, ["lk"], ["ln"], _DETAIL_RULES).select("diff_type", "business_key")


@query(f"""WITH {LINES_SQL}, s AS (SELECT lk, part, qty, ext, row_number() OVER (PARTITION BY lk ORDER BY ln, part, qty, ext) AS rn FROM li), t AS (SELECT lk, part, qty, ext, row_number() OVER (PARTITION BY lk ORDER BY ln, part, qty, ext) AS rn FROM lc), j AS (SELECT s.lk, s.rn, s.part AS a1, t.part AS b1, s.qty AS a2, t.qty AS b2, s.ext AS a3, t.ext AS b3 FROM s JOIN t ON s.lk = t.lk AND s.rn = t.rn)
    SELECT field, count(*) AS n FROM (SELECT 'part' AS field FROM j WHERE a1 <> b1 UNION ALL SELECT 'qty' FROM j WHERE a2 <> b2 UNION ALL SELECT 'ext' FROM j WHERE a3 <> b3) GROUP BY field""")
def compare_details_by_position(spark, sf_dir):
    found = ingestion.compare_details(lineitem(spark, sf_dir), lineitem_copy(spark, sf_dir), ["lk"], None, _DETAIL_RULES, order_by=["ln", "part", "qty", "ext"])
    return found.groupBy("field").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL}, a AS (SELECT lk, count(*) AS expected FROM li GROUP BY lk), b AS (SELECT lk, count(*) AS actual FROM lc GROUP BY lk) SELECT lk, expected, actual FROM a JOIN b USING (lk) WHERE expected <> actual")
def detail_count_mismatch(spark, sf_dir):
    return ingestion.detail_count_mismatch(lineitem(spark, sf_dir), lineitem_copy(spark, sf_dir), ["lk"])


@query(f"WITH {ORDERS_SQL}, {LINES_SQL} SELECT lk, ln, part, qty, ext FROM li WHERE lk NOT IN (SELECT k FROM oc)")
def orphans(spark, sf_dir):
    return ingestion.orphans(lineitem(spark, sf_dir), orders_copy(spark, sf_dir), "lk", "k")


@query(f"WITH {ORDERS_SQL}, {LINES_SQL} SELECT status, count(*) AS n, sum(ext) AS total FROM ob JOIN li ON k = lk GROUP BY status")
def attach_details(spark, sf_dir):
    return ingestion.attach_details(orders(spark, sf_dir), lineitem(spark, sf_dir), "k", "lk").groupBy("status").agg(F.count("*").alias("n"), F.sum("ext").alias("total"))


@query(f"""WITH {ORDERS_SQL}, {LINES_SQL}, g AS (SELECT k, k % 229 = 0 AS wrong FROM ob WHERE {_DOC} = 'ok'), li2 AS (SELECT lk FROM li WHERE {_GOOD})
    SELECT path, kind, n FROM (SELECT '$' AS path, 'OBJECT' AS kind, (SELECT count(*) FROM g) AS n UNION ALL SELECT '$', 'ARRAY', (SELECT count(*) FROM ob WHERE k % 211 <> 0 AND k % 223 = 0) UNION ALL SELECT '$[*]', 'BIGINT', (SELECT count(*) FROM ob WHERE k % 211 <> 0 AND k % 223 = 0)
        UNION ALL SELECT '$.orderNo', 'BIGINT', (SELECT count(*) FROM g WHERE k % 227 <> 0) UNION ALL SELECT '$.status', 'STRING', (SELECT count(*) FROM g) UNION ALL SELECT '$.price', 'STRING', (SELECT count(*) FROM g)
        UNION ALL SELECT '$.details', 'STRING', (SELECT count(*) FROM g WHERE wrong) UNION ALL SELECT '$.details', 'ARRAY', (SELECT count(*) FROM g WHERE NOT wrong) UNION ALL SELECT '$.details[*]', 'OBJECT', (SELECT count(*) FROM li2)
        UNION ALL SELECT '$.details[*].line', 'BIGINT', (SELECT count(*) FROM li2) UNION ALL SELECT '$.details[*].part', 'BIGINT', (SELECT count(*) FROM li2) UNION ALL SELECT '$.details[*].qty', 'STRING', (SELECT count(*) FROM li2) UNION ALL SELECT '$.details[*].ext', 'STRING', (SELECT count(*) FROM li2)) WHERE n > 0""")
def json_paths(spark, sf_dir):
    return ingestion.json_paths(orders_json(spark, sf_dir), "doc")


@query(f"WITH {ORDERS_SQL} SELECT k AS id, CASE WHEN {_DOC} = 'ok' AND k % 227 <> 0 THEN k END AS \"orderNo\", CASE WHEN {_DOC} = 'ok' THEN status END AS status FROM ob")
def parse_params(spark, sf_dir):
    return ingestion.parse_params(orders_json(spark, sf_dir), "doc", {"orderNo": "bigint", "status": "string"}, ["id"])


def _planted_docs(spark, sf_dir):
    """The documents with more planted: keys that are unreadable, null or blank, no status, an unreadable price, no details, and every
    257th loaded twice, every other of these under the same id."""
    k = F.col("id")
    cut = lambda doc, when, pattern, by: F.when(when, F.regexp_replace(doc, pattern, by)).otherwise(doc)
    doc = cut(F.col("doc"), k % 233 == 0, r'"orderNo":\d+', '"orderNo":"x"')
    doc = cut(doc, (k % 227 == 0) & (k % 3 == 1), r"^\{", '{"orderNo":null,')
    doc = cut(doc, (k % 227 == 0) & (k % 3 == 2), r"^\{", '{"orderNo":" ",')
    doc = cut(doc, k % 241 == 0, r'"status":"[^"]*",', "")
    doc = cut(doc, k % 251 == 0, r'"price":"[^"]*"', '"price":"abc"')
    doc = cut(doc, k % 263 == 0, r',"details":.*\}$', "}")
    docs = ingestion.parse_documents(orders_json(spark, sf_dir).select("id", doc.alias("doc")), "doc")
    return docs.withColumn("id", F.explode(F.when((k % 257 == 0) & (k != 0), F.array(k, F.when(k % 514 == 0, k).otherwise(-k))).otherwise(F.array(k))))


_SPEC = ingestion.DocumentSpec("id", "doc", keys=(N.FieldRule("k", json_path="$.orderNo", kind="int"),), fields=(N.FieldRule("status", json_path="$.status", required=True), N.FieldRule("price", json_path="$.price", kind="decimal")), header_id="k", detail_path="$.details", detail_required=True, detail_fk="lk", detail_keys=(N.FieldRule("ln", json_path="$.line", kind="int"),), detail_fields=(N.FieldRule("part", json_path="$.part", kind="int"), N.FieldRule("qty", json_path="$.qty", kind="decimal"), N.FieldRule("ext", json_path="$.ext", kind="decimal")))


def _ingestion(spark, sf_dir):
    return ingestion.verify_ingestion(_planted_docs(spark, sf_dir), orders_copy(spark, sf_dir), lineitem_copy(spark, sf_dir), _SPEC)


_NONE = "NULL AS detail_key, NULL AS field, NULL AS expected, NULL AS actual"
_INGESTION = f"""{ORDERS_SQL}, {LINES_SQL},
    d0 AS (SELECT k AS id, 1 AS r, k, status, price FROM ob UNION ALL SELECT CASE WHEN k % 514 = 0 THEN k ELSE -k END, 2, k, status, price FROM ob WHERE k % 257 = 0 AND k <> 0),
    d AS (SELECT *, CASE WHEN k % 211 = 0 THEN 'SOURCE_JSON_INVALID' WHEN k % 223 = 0 THEN 'SOURCE_JSON_NOT_OBJECT' WHEN k % 227 = 0 THEN 'ORDER_SOURCE_KEY_MISSING' WHEN k % 233 = 0 THEN 'ORDER_SOURCE_KEY_ERROR' END AS bad FROM d0),
    h AS (SELECT k, count(*) AS tn, min(status) AS ts, min(price) AS tp FROM oc GROUP BY k),
    g AS (SELECT d.*, tn, ts, tp, CASE WHEN d.k % 263 = 0 THEN 'DETAIL_ARRAY_MISSING' WHEN d.k % 229 = 0 THEN 'DETAIL_ARRAY_NOT_LIST' END AS lost FROM d LEFT JOIN h USING (k) WHERE bad IS NULL),
    one AS (SELECT * FROM g WHERE tn = 1),
    ns AS (SELECT lk, count(*) AS n FROM li GROUP BY lk), nt AS (SELECT lk, count(*) AS n FROM lc GROUP BY lk),
    s AS (SELECT id, r, k, ln, count(*) AS sn, min(part) AS p1, min(qty) AS q1, min(ext) AS e1 FROM one JOIN li ON lk = k WHERE lost IS NULL GROUP BY 1, 2, 3, 4),
    t AS (SELECT id, r, k, ln, count(*) AS tn, min(part) AS p2, min(qty) AS q2, min(ext) AS e2 FROM one JOIN lc ON lk = k WHERE lost IS DISTINCT FROM 'DETAIL_ARRAY_NOT_LIST' GROUP BY 1, 2, 3, 4),
    b AS (SELECT coalesce(s.id, t.id) AS id, coalesce(s.k, t.k) AS k, coalesce(s.ln, t.ln) AS ln, sn, tn, p1, q1, e1, p2, q2, e2 FROM s FULL JOIN t ON s.id = t.id AND s.r = t.r AND s.ln = t.ln),
    f AS (SELECT *, sn = 1 AND tn = 1 AS single FROM b),
    v AS (
        SELECT bad AS diff_type, CAST(id AS VARCHAR) AS source_id, CASE WHEN bad = 'ORDER_SOURCE_KEY_MISSING' THEN '<NULL>' END AS business_key, {_NONE} FROM d WHERE bad IS NOT NULL
        UNION ALL SELECT 'SOURCE_BUSINESS_KEY_DUPLICATE', NULL, CAST(k AS VARCHAR), {_NONE} FROM d WHERE bad IS NULL GROUP BY k HAVING count(*) > 1
        UNION ALL SELECT 'ORDER_TARGET_MISSING', CAST(id AS VARCHAR), CAST(k AS VARCHAR), {_NONE} FROM g WHERE tn IS NULL
        UNION ALL SELECT 'ORDER_TARGET_DUPLICATE', CAST(id AS VARCHAR), CAST(k AS VARCHAR), {_NONE} FROM g WHERE tn > 1
        UNION ALL SELECT CASE WHEN k % 241 = 0 THEN 'ORDER_REQUIRED_SOURCE_VALUE_MISSING' ELSE 'ORDER_FIELD_MISMATCH' END, CAST(id AS VARCHAR), CAST(k AS VARCHAR), NULL, 'status', CASE WHEN k % 241 <> 0 THEN status END, ts FROM one WHERE k % 241 = 0 OR status <> ts
        UNION ALL SELECT CASE WHEN k % 251 = 0 THEN 'ORDER_NORMALIZE_ERROR' ELSE 'ORDER_FIELD_MISMATCH' END, CAST(id AS VARCHAR), CAST(k AS VARCHAR), NULL, 'price', CASE WHEN k % 251 <> 0 THEN CAST(price AS VARCHAR) END, CAST(tp AS VARCHAR) FROM one WHERE k % 251 = 0 OR price <> tp
        UNION ALL SELECT lost, CAST(id AS VARCHAR), CAST(k AS VARCHAR), {_NONE} FROM one WHERE lost IS NOT NULL
        UNION ALL SELECT 'DETAIL_COUNT_MISMATCH', CAST(id AS VARCHAR), CAST(k AS VARCHAR), NULL, NULL, CAST(CASE WHEN lost IS NULL THEN coalesce(ns.n, 0) ELSE 0 END AS VARCHAR), CAST(coalesce(nt.n, 0) AS VARCHAR) FROM one LEFT JOIN ns ON ns.lk = k LEFT JOIN nt ON nt.lk = k WHERE lost IS DISTINCT FROM 'DETAIL_ARRAY_NOT_LIST' AND CASE WHEN lost IS NULL THEN coalesce(ns.n, 0) ELSE 0 END <> coalesce(nt.n, 0)
        UNION ALL SELECT 'DETAIL_SOURCE_KEY_DUPLICATE', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), NULL, NULL, NULL FROM f WHERE sn > 1
        UNION ALL SELECT 'DETAIL_TARGET_KEY_DUPLICATE', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), NULL, NULL, NULL FROM f WHERE tn > 1
        UNION ALL SELECT 'DETAIL_TARGET_MISSING', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), NULL, NULL, NULL FROM f WHERE tn IS NULL
        UNION ALL SELECT 'DETAIL_TARGET_EXTRA', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), NULL, NULL, NULL FROM f WHERE sn IS NULL
        UNION ALL SELECT 'DETAIL_FIELD_MISMATCH', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), 'part', CAST(p1 AS VARCHAR), CAST(p2 AS VARCHAR) FROM f WHERE single AND p1 <> p2
        UNION ALL SELECT 'DETAIL_FIELD_MISMATCH', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), 'qty', CAST(q1 AS VARCHAR), CAST(q2 AS VARCHAR) FROM f WHERE single AND q1 <> q2
        UNION ALL SELECT 'DETAIL_FIELD_MISMATCH', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(ln AS VARCHAR), 'ext', CAST(e1 AS VARCHAR), CAST(e2 AS VARCHAR) FROM f WHERE single AND e1 <> e2
        UNION ALL SELECT 'ORPHAN_DETAIL', NULL, CAST(lk AS VARCHAR), CAST(ln AS VARCHAR), NULL, NULL, NULL FROM lc WHERE lk NOT IN (SELECT k FROM oc)
    )"""


@query(f"WITH {_INGESTION} SELECT * FROM v")
def verify_ingestion(spark, sf_dir):
    return _ingestion(spark, sf_dir).select("diff_type", "source_id", "business_key", "detail_key", "field", "expected", "actual")


@query(f"""WITH {_INGESTION} SELECT diff_type, CASE WHEN diff_type IN ('ORPHAN_DETAIL', 'SOURCE_BUSINESS_KEY_DUPLICATE', 'ORDER_TARGET_DUPLICATE', 'DETAIL_SOURCE_KEY_DUPLICATE', 'DETAIL_TARGET_KEY_DUPLICATE') THEN 'relationship' WHEN diff_type LIKE 'SOURCE%' OR diff_type LIKE 'ORDER_SOURCE_KEY%' THEN 'source' WHEN diff_type LIKE 'ORDER%' THEN 'order' ELSE 'detail' END AS category,
    diff_type IN ('SOURCE_JSON_INVALID', 'SOURCE_JSON_NOT_OBJECT', 'DETAIL_ARRAY_NOT_LIST', 'ORDER_SOURCE_KEY_ERROR', 'ORDER_REQUIRED_SOURCE_VALUE_MISSING', 'ORDER_NORMALIZE_ERROR') AS blocking, CASE WHEN diff_type LIKE 'DETAIL%' OR diff_type = 'ORPHAN_DETAIL' THEN 'detail' WHEN diff_type LIKE 'SOURCE_JSON%' THEN 'document' ELSE 'order' END AS scope, count(*) AS n FROM v GROUP BY ALL""")
def classify_ingestion(spark, sf_dir):
    return _ingestion(spark, sf_dir).groupBy("diff_type", "category", "blocking", "scope").agg(F.count("*").alias("n"))


@query(f"WITH {_INGESTION} SELECT (SELECT count(*) FROM d) AS source_rows, (SELECT count(*) FROM d WHERE bad IS NULL OR bad LIKE 'ORDER%') AS valid_json, (SELECT count(*) FROM one) AS headers_checked, (SELECT coalesce(sum(n), 0) FROM one JOIN nt ON lk = k) AS details_checked, (SELECT count(*) FROM v) AS diffs")
def ingestion_summary(spark, sf_dir):
    docs, header, detail = _planted_docs(spark, sf_dir), orders_copy(spark, sf_dir), lineitem_copy(spark, sf_dir)
    return ingestion.ingestion_summary(docs, header, detail, _SPEC)[0]


_two_sided = lambda: [N.FieldRule("segment", source_column="seg_src", category="business"), N.FieldRule("origin", constant="crm"), N.FieldRule("double_key", computed=F.col("c_custkey") * 2, kind="int"), N.FieldRule("nation", json_path="$.a.n", kind="int"), N.FieldRule("note", source_column="note_src", empty_as_null=True, kind="int"), N.FieldRule("zeros", source_column="zero_src", source_transforms=("zero_to_null",), target_transforms=("empty_to_null",), kind="int"), N.FieldRule("cents", source_column="cents_src", source_transforms=("cents_to_decimal",), kind="decimal")]


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey <> 50 THEN CAST(c_custkey AS VARCHAR) ELSE '<NULL>' END AS business_key, c_mktsegment AS seg, c_nationkey AS n FROM customer),
    d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE k % 23 = 0),
    v AS (SELECT 'SOURCE_BUSINESS_KEY_DUPLICATE' AS diff_type, business_key, NULL AS field, NULL AS expected, NULL AS actual FROM c WHERE k % 23 = 0
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', business_key, 'segment', seg, lower(seg) FROM d WHERE k % 7 = 0
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', business_key, 'origin', 'crm', 'erp' FROM d WHERE k % 11 = 0
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', business_key, 'double_key', CAST(k * 2 AS VARCHAR), CAST(k * 2 + 1 AS VARCHAR) FROM d WHERE k % 13 = 0
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', business_key, 'nation', CAST(n AS VARCHAR), CAST(n + 1 AS VARCHAR) FROM d WHERE k % 17 = 0
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', business_key, 'note', NULL, '5' FROM d WHERE k % 19 = 0
        UNION ALL SELECT 'ORDER_NORMALIZE_ERROR', business_key, 'note', NULL, NULL FROM d WHERE k % 29 = 0 AND k % 19 <> 0
        UNION ALL SELECT 'ORDER_FIELD_MISMATCH', business_key, 'zeros', NULL, '3' FROM d WHERE k % 31 = 0
        UNION ALL SELECT 'ORDER_NORMALIZE_ERROR', business_key, 'cents', NULL, '1.00' FROM d WHERE k % 37 = 0)
    SELECT * FROM v""")
def reconcile_two_sided(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    key = F.when(k != 50, k).alias("k")
    source = c.select(key, "c_custkey", F.col("c_mktsegment").alias("seg_src"), F.format_string('{"a":{"n":%d}}', "c_nationkey").alias("doc"), F.when((k % 29 == 0) & (k % 19 != 0), "x").otherwise("").alias("note_src"), F.lit("0.0").alias("zero_src"), F.when(k % 37 == 0, "?").otherwise("100").alias("cents_src"))
    target = c.select(key, F.when(k % 7 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 11 == 0, "erp").otherwise("crm").alias("origin"), (k * 2 + F.when(k % 13 == 0, 1).otherwise(0)).alias("double_key"), (F.col("c_nationkey") + F.when(k % 17 == 0, 1).otherwise(0)).alias("nation"), F.when(k % 19 == 0, "5").alias("note"), F.when(k % 31 == 0, "3").otherwise("").alias("zeros"), F.lit("1").alias("cents"))
    found = reconcile.reconcile(source.union(source.where(F.col("c_custkey") % 23 == 0)), target, ["k"], _two_sided(), "doc")
    return found.select("diff_type", "business_key", "field", "expected", "actual")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def business_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(*reconcile.business_columns(c.columns, ["C_NATIONKEY", "c_mktsegment"]))


@query("SELECT o_orderkey AS source_id, o_totalprice < 1 AS zero, o_orderkey % 3 <> 0 AS pre_sale, CAST(o_orderkey AS VARCHAR) AS own FROM orders")
def computed_fields(spark, sf_dir):
    doc = F.concat(F.lit('{"order_amount": '), F.floor("o_totalprice"), F.lit(', "pre_sale_type": '), F.col("o_orderkey") % 3, F.lit("}"))
    rules = [N.FieldRule("zero", computed="zero_order_amount"), N.FieldRule("pre_sale", computed="pre_sale_type_nonzero"), N.FieldRule("own", computed="source_id")]
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), doc.alias("doc"))
    return N.normalize_table(o, rules, "source", "doc", ["source_id"]).select("source_id", F.col("zero").cast("boolean"), F.col("pre_sale").cast("boolean"), "own")


@query("SELECT o_orderkey, coalesce(c_mktsegment, CAST(o_custkey AS VARCHAR)) AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0")
def map_values(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("from_value"), F.col("c_mktsegment").alias("to_value"))
    return N.map_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", pairs)


@query("SELECT o_orderstatus, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'both_empty' WHEN o_orderkey % 3 = 0 THEN 'target_empty' WHEN o_orderkey % 2 = 0 THEN 'source_empty' ELSE 'same' END AS side, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2")
def empty_side_range(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", k.alias("key"), F.when(k % 2 != 0, "v").alias("a"), F.when(k % 3 != 0, "v").otherwise(" ").alias("b"))
    return N.empty_side_range(o, ["o_orderstatus"], "a", "b")


_JSON_RULES = [N.FieldRule("status", json_path="$.status", required=True), N.FieldRule("price", json_path="$.price", kind="decimal"), N.FieldRule("no", json_path="$.number", fallback_paths=("$.orderNo",), kind="int", default="0")]


@query(f"WITH {ORDERS_SQL} SELECT k AS id, CASE WHEN {_DOC} = 'ok' THEN status END AS status, CASE WHEN {_DOC} = 'ok' THEN CAST(price AS VARCHAR) END AS price, CASE WHEN {_DOC} = 'ok' AND k % 227 <> 0 THEN CAST(k AS VARCHAR) ELSE '0' END AS no, {_DOC} <> 'ok' OR k % 227 = 0 AS no__missing FROM ob")
def normalize_documents(spark, sf_dir):
    return N.normalize_table(orders_json(spark, sf_dir), _JSON_RULES, "source", "doc", ["id"]).select("id", "status", "price", "no", "no__missing")


# ---- expressions -------------------------------------------------------------------------------------

@query("SELECT o_orderkey AS k, CAST(CAST(CAST(trunc(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,9))) AS BIGINT) AS BIGINT) AS VARCHAR) AS as_int, CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,1)) AS VARCHAR) AS as_decimal, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS mapped, CASE WHEN o_custkey % 11 BETWEEN 0 AND 1 THEN 'pending' WHEN o_custkey % 11 = 2 THEN 'success' WHEN o_custkey % 11 BETWEEN 3 AND 7 THEN 'failed' ELSE 'running' END AS state, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 10 AS VARCHAR) END AS nonzero, o_orderkey || '|' || coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END, '<NULL>') AS key FROM orders")
def normalize_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    return o.select(
        F.col("o_orderkey").alias("k"),
        N.norm(F.col("o_totalprice"), "int").alias("as_int"),
        N.norm(F.col("o_totalprice"), "decimal", 1).alias("as_decimal"),
        N.value_map(F.col("o_orderstatus"), {"O": "open", "F": "done"}).alias("mapped"),
        N.range_map(F.col("o_custkey") % 11, [(0, 1, "pending"), (2, 2, "success"), (3, 7, "failed")], "running").alias("state"),
        N.norm(F.col("o_orderdate"), "date").alias("day"),
        N.zero_to_null(F.col("o_custkey") % 10).alias("nonzero"),
        N.canonical_key(F.col("o_orderkey"), part).alias("key"),
    )


@query("SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS seconds, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS auto, strftime(ts, '%Y-%m-%d %H:%M:%S') AS whole, CAST(CAST(event_id AS DECIMAL(18,4)) / 100 AS DECIMAL(30,4)) AS cents, '{\"a\":' || event_id || ',\"b\":1}' AS doc, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'passed' ELSE 'unknown' END AS status, event_id % 2 = 1 AS truthy, CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END AS flag FROM events")
def transform_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{ "b": 1, "a": '), F.col("event_id"), F.lit("}"))
    word = F.when(F.col("event_type") == "error", "Error ").when(F.col("event_type") == "view", "OK").otherwise("?")
    return e.select(
        "event_id",
        N.unix_seconds(F.col("event_id") + 1_700_000_000).alias("seconds"),
        N.unix_auto((F.col("event_id") + 1_700_000_000) * 1000).alias("auto"),
        N.norm(F.col("ts"), "datetime").alias("whole"),
        N.cents_to_decimal(F.col("event_id")).cast("decimal(30,4)").alias("cents"),
        N.canonical_json(doc).alias("doc"),
        N.norm_status(word).alias("status"),
        N.truthy_number(F.col("event_id") % 2).alias("truthy"),
        N.norm((F.col("event_id") % 2), "bool").alias("flag"),
    )


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) AS alnum, 'supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS snake, sha256(CAST(s_suppkey AS VARCHAR) || '|<NULL>') AS hashed, CASE WHEN s_nationkey = 0 THEN 'target_empty' WHEN s_nationkey = 1 THEN 'source_empty' WHEN s_nationkey = 2 THEN 'same' ELSE 'both_set_different' END AS side FROM supplier")
def name_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_nationkey")
    return s.select(
        "s_suppkey",
        N.alnum_key(F.col("s_name")).alias("alnum"),
        N.snake_case(F.col("s_name")).alias("snake"),
        R.hash_sample(F.col("s_suppkey"), F.lit(None)).alias("hashed"),
        N.empty_side(F.when(n != 1, F.lit("a")), F.when(n == 2, F.lit("a")).when(n != 0, F.lit("b")).otherwise(F.lit(" "))).alias("side"),
    )


@query("SELECT p_partkey, 'brand:' || p_brand || ';type:' || p_type AS spec, CAST(CAST(p_size AS DECIMAL(38,6)) * 1000000 AS DECIMAL(38,6)) AS micros, 'V' || p_size || '.1' AS version, CASE WHEN p_size = 7 THEN 'exact' ELSE 'excluded' END AS match7, 3 AS n_notes, lower(replace(p_name, ' ', '')) AS plain, string_split(lower(p_name), ' ')[1] || ',' || string_split(lower(p_name), ' ')[2] AS tokens, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS required FROM part")
def text_helpers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    spec = F.to_json(F.array(F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("name"), F.col("p_type").alias("value"))))
    version = F.concat(F.lit(" v"), F.col("p_size"), F.lit(".1"))
    return p.select(
        "p_partkey",
        N.spec_to_text(spec).alias("spec"),
        N.scaled(F.col("p_size"), 1_000_000).cast("decimal(38,6)").alias("micros"),
        N.norm_version(version).alias("version"),
        N.version_match(F.col("p_size").cast("string"), "7").alias("match7"),
        F.size(N.split_notes(F.concat(F.lit("Costs "), F.col("p_size"), F.lit(".5 a piece. Second; third。")))).alias("n_notes"),
        N.norm_text(F.col("p_name")).alias("plain"),
        F.array_join(N.token_set(F.initcap("p_name")), ",").alias("tokens"),
        N.required_flag(F.when(F.col("p_size") % 3 == 0, "Yes").when(F.col("p_size") % 3 == 1, "optional").otherwise("?")).alias("required"),
    )


_SECRET_SQL = "SELECT doc_id, '{0}' AS finding FROM documents WHERE regexp_matches(text, '{1}')"


@query(" UNION ALL ".join(_SECRET_SQL.format(n, p.replace("'", "''")) for n, p in R.SECRET_PATTERNS.items()))
def scan_secrets(spark, sf_dir):
    return R.scan_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query(r"SELECT doc_id, 'question marks' AS finding FROM documents WHERE regexp_matches(text, '\?{4,}') UNION ALL SELECT doc_id, 'replacement character' FROM documents WHERE contains(text, chr(65533)) UNION ALL SELECT doc_id, 'unicode escape' FROM documents WHERE regexp_matches(text, '\\u[0-9a-fA-F]{4}')")
def scan_garbled(spark, sf_dir):
    return R.scan_garbled(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{12,}', '\1<redacted>', 'g'), '(?i)([?&](?:token|password|secret|access_token|refresh_token)=)[^&\s]+', '\1<redacted>', 'g'), '(?i)((?:token|password|passwd|pwd|secret|signature|passphrase|credential|api[-_. ]?key|access[-_. ]?key|private[-_. ]?key)["'']?\s*[:=]\s*["'']?)[A-Za-z0-9+/_.=-]{8,}', '\1<redacted>', 'g')) AS digest FROM documents""")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.redact_text(F.col("text"))).alias("digest"))


@query("SELECT event_id, '{\"access_token\":\"<redacted>\",\"k\":' || json_extract_string(props, '$.k') || ',\"token_count\":3}' AS doc FROM events")
def redact_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"token_count": 3, "access_token": "abc", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return e.select("event_id", R.redact_json(doc).alias("doc"))


_KEYS = {"account_password": True, "discount_secret": True, "token_count": False, "tokenTotal": False, "accounttoken": True, "session_id": True, "set_cookie": True, "kind": False, "secret_count": True, "access_key_scope": True, "api_key": True, "pwd": True, "accessKey": True, "privateKey": True, "app-secret": True, "X-Auth-Token": True, "dbCredential": True, "keyboard": False}


@query("SELECT event_id, " + ", ".join(f"'{'<redacted>' if hidden else 'v'}' AS \"{key}\"" for key, hidden in _KEYS.items()) + ", '<redacted>' AS nested, 'v' AS plain FROM events")
def redact_keys(spark, sf_dir):
    values = F.concat(F.lit("{" + "".join(f'"{k}": "v", ' for k in _KEYS) + '"cookies": [1, {"a": ["x", "}"]}, null], "list": [{"api_secret": {"k": [1, 2]}, "plain": "v"}], "k": '), F.col("event_id"), F.lit("}"))
    held = N.parse_json(R.redact_json(values))
    return spread(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", *[N.json_text(held, f"$['{k}']").alias(k) for k in _KEYS], F.when(N.json_text(held, "$.cookies") == R.HIDDEN, N.json_text(held, "$.list[0].api_secret")).alias("nested"), N.json_text(held, "$.list[0].plain").alias("plain"))


# ---- chains and relations ----------------------------------------------------------------------------

def _layers(spark, sf_dir):
    o = orders(spark, sf_dir)
    staging = o.where("k % 103 <> 0")
    return [("source", o), ("staging", staging), ("target", staging.where("k % 97 <> 0"))]


@query("SELECT o_orderkey AS k, 'source' AS first_layer, CASE WHEN o_orderkey % 103 = 0 THEN 'staging' ELSE 'target' END AS lost_at FROM orders WHERE o_orderkey % 103 = 0 OR o_orderkey % 97 = 0")
def reconcile_staged(spark, sf_dir):
    return chain.reconcile_staged(_layers(spark, sf_dir), KEYS)


@query("SELECT 'source->staging' AS stage, count(*) FILTER (o_orderkey % 103 <> 0) AS kept, count(*) FILTER (o_orderkey % 103 = 0) AS lost, 0 AS gained FROM orders UNION ALL SELECT 'staging->target', count(*) FILTER (o_orderkey % 97 <> 0), count(*) FILTER (o_orderkey % 97 = 0), 0 FROM orders WHERE o_orderkey % 103 <> 0 UNION ALL SELECT 'source->target', count(*) FILTER (o_orderkey % 103 <> 0 AND o_orderkey % 97 <> 0), count(*) FILTER (o_orderkey % 103 = 0 OR o_orderkey % 97 = 0), 0 FROM orders")
def stage_counts(spark, sf_dir):
    return chain.stage_counts(_layers(spark, sf_dir), KEYS)


@query("WITH t AS (SELECT o_orderkey AS c, CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE o_custkey + 1000000 END AS p FROM orders WHERE o_orderkey % 37 <> 0) SELECT o_orderkey AS child, CASE WHEN o_custkey % 41 = 0 THEN 'unmapped' WHEN o_orderkey % 37 = 0 THEN 'missing' ELSE 'different' END AS finding FROM orders WHERE o_custkey % 41 = 0 OR o_orderkey % 37 = 0 OR o_orderkey % 31 = 0")
def check_relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = table(spark, sf_dir, "customer").where("c_custkey % 41 <> 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1_000_000).alias("new_id"))
    moved = F.when(F.col("o_orderkey") % 31 == 0, 0).otherwise(F.col("o_custkey") + 1_000_000)
    target = o.where("o_orderkey % 37 <> 0").select("o_orderkey", moved.alias("o_custkey"))
    return chain.check_relations(o, ids, target, "o_orderkey", "o_custkey")


@query("SELECT url, 'missing' AS finding FROM pages WHERE page_id % 17 = 0 UNION ALL SELECT url, 'different_size' FROM pages WHERE page_id % 17 <> 0 AND page_id % 13 = 0 UNION ALL SELECT 'extra' || page_id, 'extra' FROM pages WHERE page_id % 19 = 0")
def check_files(spark, sf_dir):
    """Each page is a file; some pages share their url, so the number of the page is a part of the key."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("size"))
    kept = p.where("page_id % 17 <> 0").withColumn("size", F.when(F.col("page_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    more = p.where("page_id % 19 = 0").withColumn("url", F.concat(F.lit("extra"), F.col("page_id")))
    return chain.check_files(p, kept.union(more), ["page_id", "url"], ["size"]).select("url", "finding")


@query("SELECT event_type, CASE WHEN bool_or(user_id % 50 = 0) THEN 'staged' ELSE 'direct' END AS chain_type FROM events GROUP BY event_type")
def chain_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 50 == 0, F.col("event_id")).alias("staging_id"), F.lit("").alias("staging_evidence"))
    return chain.chain_type(e, ["event_type"])


@query("SELECT c_custkey AS k, 'not_in_target' AS finding FROM customer WHERE c_custkey % 23 = 0 UNION ALL SELECT c_custkey, 'not_written_back' FROM customer WHERE c_custkey % 29 = 0 UNION ALL SELECT c_custkey, 'different_c_name' FROM customer WHERE c_custkey % 19 = 0 AND c_custkey % 23 <> 0 AND c_custkey % 29 <> 0")
def document_mapping(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    target = c.where("k % 23 <> 0").withColumn("c_name", F.when(F.col("k") % 19 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return chain.document_mapping(c, target, c.where("k % 29 <> 0"), ["k"], ["c_name", "c_mktsegment"])


# ---- coverage -----------------------------------------------------------------------------------------

def _fields(spark, sf_dir):
    """Part types as interfaces and part brands as fields, dealt to origins by their size."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("interface_name"), F.col("p_brand").alias("field_name"), "p_size")
    names = ["documented", "live", "schema", "legacy"]
    return p.select("interface_name", "field_name", F.get(F.array(*[F.lit(n) for n in names]), F.col("p_size") % 4).alias("origin"))


_FIELDS = "f AS (SELECT p_type AS interface_name, p_brand AS field_name, CASE p_size % 4 WHEN 0 THEN 'documented' WHEN 1 THEN 'live' WHEN 2 THEN 'schema' ELSE 'legacy' END AS origin FROM part), g AS (SELECT interface_name, field_name, bool_or(origin = 'documented') AS d, bool_or(origin = 'live') AS l, bool_or(origin = 'schema') AS s, bool_or(origin = 'legacy') AS o FROM f GROUP BY 1, 2)"


@query(f"WITH {_FIELDS} SELECT interface_name, field_name, CASE WHEN NOT d AND NOT l AND NOT s THEN 'baseline_blocked' WHEN l AND NOT d THEN 'live_extra' WHEN s AND NOT l AND NOT d THEN 'schema_only' WHEN (l OR d) AND NOT s THEN 'schema_missing' WHEN d AND s AND NOT l THEN 'sample_not_covered' ELSE 'aligned' END AS finding FROM g")
def field_baseline(spark, sf_dir):
    return coverage.field_baseline(_fields(spark, sf_dir))


_CLASSES = f"{_FIELDS}, c AS (SELECT interface_name, field_name, CASE WHEN l THEN 'mapped' WHEN s THEN 'not_applicable' WHEN o THEN 'uncollected' ELSE 'unmapped' END AS class FROM g WHERE d OR l)"


def _classes(spark, sf_dir):
    f = _fields(spark, sf_dir)
    at = lambda *o: f.where(F.col("origin").isin(*o)).select("interface_name", "field_name").distinct()
    return coverage.field_rule_coverage(at("documented", "live"), at("live"), at("schema"), at("legacy"))


@query(f"WITH {_CLASSES} SELECT interface_name, field_name, class FROM c")
def field_rule_coverage(spark, sf_dir):
    return _classes(spark, sf_dir)


@query(f"WITH {_CLASSES} SELECT interface_name, count(*) AS total, count(*) FILTER (class = 'mapped') AS mapped, count(*) FILTER (class = 'not_applicable') AS not_applicable, count(*) FILTER (class = 'uncollected') AS uncollected, count(*) FILTER (class = 'unmapped') AS unmapped, CASE WHEN count(*) FILTER (class = 'unmapped') = 0 THEN 'PASS' ELSE 'FAIL' END AS gate FROM c GROUP BY 1")
def coverage_gate(spark, sf_dir):
    return coverage.coverage_gate(_classes(spark, sf_dir))


@query(f"WITH {_FIELDS} SELECT interface_name, field_name FROM g WHERE d AND NOT s")
def not_persisted(spark, sf_dir):
    f = _fields(spark, sf_dir)
    at = lambda o: f.where(F.col("origin") == o).select("interface_name", "field_name").distinct()
    return coverage.not_persisted(at("documented"), at("schema"))


@query("SELECT DISTINCT p_type || '/' || p_brand AS check_name, 'NOT_VERIFIED' AS status FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = p.p_type AND q.p_brand = p.p_brand AND q.p_size % 5 = 0)")
def coverage_gaps(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("check_name"), "p_size")
    return coverage.coverage_gaps(p.select("check_name").distinct(), p.where("p_size % 5 = 0").select("check_name"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'BLOCKED' WHEN p_size % 7 = 1 THEN 'WARN' ELSE 'PASS' END AS status FROM part")
def rule_consistency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("expected_rule"), F.when(F.col("p_size") % 7 == 1, F.lit("?")).when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("used_rule"))
    return coverage.rule_consistency(p).select("p_partkey", "status")


@query(f"WITH {ORDERS_SQL}, r AS (SELECT count(*) FILTER (cust IS NOT NULL) AS n FROM oc) SELECT field_name, class FROM (SELECT 'k' AS field_name, 'mapped' AS class UNION ALL SELECT 'status', 'mapped' UNION ALL SELECT 'note', 'mapped_not_written' UNION ALL SELECT 'zero', 'without_source_all_zero' UNION ALL SELECT 'ghost', 'only_in_map' UNION ALL SELECT 'odate', 'unmapped') WHERE (SELECT n FROM r) > 0")
def field_coverage(spark, sf_dir):
    t = orders_copy(spark, sf_dir).select("k", "status", F.lit(None).cast("string").alias("note"), F.lit(0).alias("zero"))
    profile = reconcile.value_profile(t, ["k", "status", "note", "zero"])
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "field_name string")
    return coverage.field_coverage(names("k", "status", "note", "odate"), names("k", "status", "note", "ghost"), profile)


# ---- deduplication ------------------------------------------------------------------------------------

@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_id, user_id, event_type FROM r WHERE rn = 1")
def latest_snapshot(spark, sf_dir):
    return dedupe.latest_snapshot(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS c FROM events) SELECT event_id, 'first' AS which FROM r WHERE a = 1 UNION ALL SELECT event_id, 'last' FROM r WHERE b = 1 UNION ALL SELECT event_id, 'best' FROM r WHERE c = 1")
def first_last_best(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    picks = {"first": dedupe.first_by(e, ["user_id"], ["event_id"]), "last": dedupe.last_by(e, ["user_id"], ["event_id"]), "best": dedupe.keep_best(e, ["user_id"], F.col("value"), ["event_id"])}
    out = [df.select("event_id", F.lit(n).alias("which")) for n, df in picks.items()]
    return out[0].union(out[1]).union(out[2])


@query(r"WITH k AS (SELECT doc_id, source, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS key, length(text) AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY key) AS n_copies FROM k) SELECT doc_id, n_copies FROM r WHERE rn = 1")
def keep_fullest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.regexp_replace("text", r"\s+", ""))).alias("key"), F.length("text").alias("n"), "source")
    return dedupe.keep_fullest(d, ["key"], F.col("n"), ["doc_id"], "source").select("doc_id", "n_copies")


@query("SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '_' || rn END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def suffix_duplicates(spark, sf_dir):
    return dedupe.suffix_duplicates(table(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query(r"""WITH s AS (SELECT doc_id, source AS title, text, md5(text) AS e, md5(regexp_replace(lower(regexp_replace(text, '\s+', '', 'g')), ';+$', '')) AS p FROM documents), w AS (SELECT *, count(*) OVER (PARTITION BY title, e) AS ne, count(*) OVER (PARTITION BY title, p) AS ns FROM s), t AS (SELECT title, count(DISTINCT p) AS nt FROM s GROUP BY title), x AS (SELECT p, count(DISTINCT title) AS nx FROM s GROUP BY p)
    SELECT doc_id, CASE WHEN ne > 1 THEN 'exact_duplicate' WHEN ns > 1 THEN 'format_duplicate' WHEN nt > 1 THEN 'title_variant' WHEN nx > 1 THEN 'retitled' ELSE 'unique' END AS class FROM w JOIN t USING (title) JOIN x USING (p)""")
def dedupe_statements(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return dedupe.dedupe_statements(d, "title", "text").select("doc_id", "class")


@query("WITH b AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_nationkey) - 1 AS at FROM b), m AS (SELECT count(*) AS m FROM b) SELECT i AS row_index, c_mktsegment, c_nationkey FROM range(300) r(i), m JOIN o ON true WHERE o.at = i % m.m")
def reference_rows(spark, sf_dir):
    return dedupe.reference_rows(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 300, distinct=False)
