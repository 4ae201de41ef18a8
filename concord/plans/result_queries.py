"""Generation, rollups, gates, captured responses, pages, locators, catalogues and matching over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datagen, gates, locators, pages, responses, rollup, schema_match
from ..sources import tables
from .fixtures import spread, table
from .registry import query

# ---- test-data generation --------------------------------------------------------------------------

_RULES = {
    "code": {"type": "sequence", "prefix": "C", "start": 1, "width": 6},
    "state": {"type": "enum", "values": ["new", "open", "done"]},
    "amount": {"type": "decimal_range", "min": 1, "max": 500, "scale": 2},
    "size": {"type": "int_range", "min": 10, "max": 99},
    "made": {"type": "datetime", "mode": "offset", "seconds_per_row": 60},
    "token": {"type": "uuid"},
    "kind": {"type": "fixed", "value": "TEST"},
    "note": {"type": "null"},
    "mail": {"type": "email", "value": "auto@example.com"},
}


def _hash(field: str, row: str = "i") -> str:
    return f"CAST(('0x' || substr(md5('42|' || {row} || '|{field}'), 1, 8)) AS BIGINT)"


_N = "(SELECT count(*) FROM customer)"
_GENERATED = f"""SELECT i AS row_index, 'C' || lpad(CAST(i + 1 AS VARCHAR), 6, '0') AS code, CASE i % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'open' ELSE 'done' END AS state, CAST({_hash('amount')} % 49901 AS DECIMAL(38,2)) / 100 + 1 AS amount, {_hash('size')} % 90 + 10 AS size,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(i AS INT)), '%Y-%m-%d %H:%M:%S') AS made, substr(md5('42|' || i || '|token'), 1, 8) || '-' || substr(md5('42|' || i || '|token'), 9, 4) || '-' || substr(md5('42|' || i || '|token'), 13, 4) || '-' || substr(md5('42|' || i || '|token'), 17, 4) || '-' || substr(md5('42|' || i || '|token'), 21, 12) AS token, 'TEST' AS kind, CAST(NULL AS VARCHAR) AS note, 'auto' || (i + 1) || '@example.com' AS mail
    FROM range(0, {_N}) r(i)"""


def _generated(spark, sf_dir):
    return datagen.generate_rows(spark, table(spark, sf_dir, "customer").count(), _RULES)


@query(_GENERATED)
def generate_rows(spark, sf_dir):
    """As many rows as there are customers."""
    return _generated(spark, sf_dir)


@query(f"WITH g AS ({_GENERATED}), c AS (SELECT * FROM customer) SELECT row_index, code, c_name AS user_name, c_mktsegment AS segment FROM g LEFT JOIN c ON c_custkey = row_index")
def attach_reference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_index")
    return datagen.attach_reference(_generated(spark, sf_dir).select("row_index", "code"), c, {"user_name": "c_name", "segment": "c_mktsegment"})


def _ratio(field: str, low: int, high: int) -> str:
    return f"(CAST({_hash(field, 'c_custkey')} % {high - low + 1} + {low} AS DECIMAL(10,0)) / 1000)"


@query(f"""WITH a AS (SELECT c_custkey AS row_index, {_hash('impressions', 'c_custkey')} % 9001 + 1000 AS impressions, {_hash('ctr', 'c_custkey')} % 171 + 30 AS ctr, {_hash('cvr', 'c_custkey')} % 141 + 10 AS cvr, {_hash('average', 'c_custkey')} % 471 + 30 AS av, CAST({_hash('coupon', 'c_custkey')} % 71 + 10 AS DECIMAL(10,0)) * CAST(0.001 AS DECIMAL(4,3)) AS cu FROM customer),
    b AS (SELECT *, greatest(1, impressions * ctr // 1000) AS clicks FROM a), c AS (SELECT *, greatest(1, clicks * cvr // 1000) AS orders FROM b) SELECT row_index, impressions, clicks, orders, CAST(orders * av AS DECIMAL(18,2)) AS gmv, CAST(round(CAST(orders * av AS DECIMAL(18,2)) * cu, 2) AS DECIMAL(18,2)) AS coupon_amount, CAST(orders * av AS DECIMAL(18,2)) + CAST(round(CAST(orders * av AS DECIMAL(18,2)) * cu, 2) AS DECIMAL(18,2)) AS gmv_include_coupon FROM c""")
def funnel_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"))
    return datagen.funnel_metrics(rows).select("row_index", "impressions", "clicks", "orders", "gmv", "coupon_amount", "gmv_include_coupon")


@query("SELECT c_custkey, 'c_acctbal' AS field, 'range' AS violation FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 9000 UNION ALL SELECT c_custkey, 'c_mktsegment', 'enum' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'c_name', 'length' FROM customer WHERE length(c_name) > 17 UNION ALL SELECT c_custkey, 'c_nationkey', 'not_unique' FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)")
def check_legality(spark, sf_dir):
    rules = {"c_acctbal": {"type": "double", "min": 0, "max": 9000}, "c_mktsegment": {"nullable": False, "values": ["BUILDING", "MACHINERY"]}, "c_name": {"max_length": 17}}
    return datagen.check_legality(table(spark, sf_dir, "customer"), "c_custkey", rules, unique=["c_nationkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def check_reference(spark, sf_dir):
    return datagen.check_reference(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0"), "c_custkey", ["o_orderkey"])


_TABLES = ("customer", "orders", "part", "supplier")


def _catalog(spark, sf_dir):
    return tables.column_catalog(spark, {t: table(spark, sf_dir, t) for t in _TABLES})


_COLUMNS = "FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'part', 'supplier')"


@query(f"SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END AS data_type, ordinal_position - 1 AS ordinal_position {_COLUMNS}")
def column_catalog(spark, sf_dir):
    kind = F.when(F.col("data_type").startswith("timestamp"), "timestamp").otherwise(F.col("data_type"))
    return _catalog(spark, sf_dir).select("table_name", "column_name", kind.alias("data_type"), "ordinal_position")


_NAMES = ("order_id", "createdAt", "click_rate", "unit_cost", "total_price", "is_open", "item_qty", "order_status", "free_note", "contact_email", "home_address", "full_name", "brand", "blob")
_TYPES = ("varchar", "bigint", "decimal")
_LETTERS = "CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'i' ELSE 'd' END"


def _part_columns(spark, sf_dir):
    """A catalogue with a column for each part: types, names, lengths and flags follow from its rows."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    pick = lambda of, i: F.get(F.array(*[F.lit(x) for x in of]), i)
    return p.select(F.concat_ws("/", "p_type", "p_brand", "p_partkey").alias("table_name"), pick(_NAMES, F.col("p_size") % 14).alias("column_name"), pick(_TYPES, (F.col("p_partkey") % 3).cast("int")).alias("data_type"), F.when(F.col("p_size") % 2 == 0, "YES").otherwise("NO").alias("is_nullable"), F.when(F.col("p_size") % 14 == 13, F.col("p_name")).alias("column_comment"), (F.col("p_size") % 5 == 0).alias("is_unique"), F.col("p_size").alias("ordinal_position"), F.lit(None).cast("int").alias("numeric_scale"))


@query(f"""WITH c AS (SELECT p_type || '/' || p_brand || '/' || p_partkey AS table_name, p_size % 14 AS n, {_LETTERS} AS t, p_size % 5 = 0 AS u FROM part)
    SELECT table_name, CASE WHEN n = 0 AND t = 'i' THEN 'number_key' WHEN n = 0 AND t = 's' THEN 'text_key' WHEN n = 1 AND t = 's' THEN 'moment' WHEN n = 2 AND t = 'd' THEN 'share' WHEN n = 2 AND t = 'i' THEN 'fallback' WHEN n = 3 AND t = 'd' THEN 'cost' WHEN n = 4 AND t <> 's' THEN 'money' WHEN n = 5 AND t = 'i' THEN 'flag' WHEN n = 6 AND t <> 's' THEN 'count' WHEN n = 7 AND t = 's' THEN 'state' WHEN n = 8 AND t = 's' THEN 'remark' WHEN n = 9 AND t = 's' THEN 'mail' WHEN n = 10 AND t = 's' THEN 'place' WHEN n = 11 AND t = 's' THEN 'name' WHEN n = 12 AND t = 's' THEN 'kind' WHEN u AND t = 's' THEN 'unique_text' ELSE 'fallback' END AS rule,
        CASE WHEN n = 4 AND t <> 's' THEN 9000 WHEN n = 0 AND t = 'i' THEN 999999 WHEN n = 6 AND t <> 's' THEN 400 WHEN n = 3 AND t = 'd' THEN 200 WHEN n = 2 AND t = 'd' THEN 0.5 WHEN n = 5 AND t = 'i' THEN 1 END AS high, CASE WHEN n = 0 AND t = 's' THEN 'ORDERID' WHEN u AND t = 's' AND n = 2 THEN 'CLICKRAT' WHEN u AND t = 's' AND n = 3 THEN 'UNITCOST' WHEN u AND t = 's' AND n = 4 THEN 'TOTALPRI' WHEN u AND t = 's' AND n = 5 THEN 'ISOPEN' WHEN u AND t = 's' AND n = 6 THEN 'ITEMQTY' WHEN u AND t = 's' AND n = 13 THEN 'BLOB' END AS prefix FROM c""")
def infer_rule(spark, sf_dir):
    return datagen.infer_rule(_part_columns(spark, sf_dir)).select("table_name", "rule", F.col("rule_spec.high").alias("high"), F.col("rule_spec.prefix").alias("prefix"))


@query("SELECT p_type AS table_name, 'c' || p_partkey AS column_name, CASE WHEN p_size % 2 = 0 THEN p_size END AS max_length, p_size % 3 = 0 AS is_primary, p_size % 3 = 0 OR p_size % 4 = 0 AS is_unique, CASE WHEN p_size % 7 > 0 THEN p_name END AS column_comment FROM part")
def information_catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("column_name", F.concat(F.lit("c"), F.col("p_partkey"))).withColumnRenamed("p_type", "table_name")
    columns = p.select("table_name", "column_name", F.lit("VARCHAR").alias("DATA_TYPE"), F.lit("yes").alias("is_nullable"), F.col("p_size").alias("ordinal_position"), F.when(F.col("p_size") % 7 > 0, F.col("p_name")).otherwise(" ").alias("column_comment"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("CHARACTER_MAXIMUM_LENGTH"))
    key = lambda n, kind: p.where(F.col("p_size") % n == 0).select("table_name", "column_name", F.lit(kind).alias("constraint_type"))
    keys = key(3, "PRIMARY KEY").union(key(4, "UNIQUE")).union(key(3, "FOREIGN KEY"))
    return tables.information_catalog(columns, keys).select("table_name", "column_name", "max_length", "is_primary", "is_unique", "column_comment")


@query("""WITH v AS (SELECT c_custkey, 'c_name' AS field, 'length' AS violation FROM customer WHERE length(c_name) > 17 UNION ALL SELECT c_custkey, 'c_nationkey', 'not_unique' FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT c_custkey, 'c_acctbal', 'range' FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 9000
        UNION ALL SELECT c_custkey, 'c_acctbal', 'precision' FROM customer WHERE abs(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(18,2))) >= 1000 UNION ALL SELECT c_custkey, 'c_mktsegment', 'null' FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', 'reference' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0) UNION ALL SELECT c_custkey, 'rich_is_even', 'condition' FROM customer WHERE c_acctbal > 5000 AND c_custkey % 2 = 1) SELECT * FROM v""")
def check_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    length = F.col("column_name").isin("c_name")
    catalog = tables.column_catalog(spark, {"customer": c}).withColumns({"is_nullable": F.when(F.col("column_name") == "c_mktsegment", "NO").otherwise("YES"), "is_unique": F.col("column_name") == "c_nationkey", "max_length": F.when(length, 17), "numeric_precision": F.when(F.col("column_name") == "c_acctbal", 5), "numeric_scale": F.when(F.col("column_name") == "c_acctbal", 2)})
    return datagen.check_table(c, "c_custkey", catalog, {"c_acctbal": {"min": 0, "max": 9000}}, references=[("c_nationkey", table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0"), "n_nationkey")], conditions=[("rich_is_even", F.col("c_acctbal") > 5000, F.col("c_custkey") % 2 == 0)])


# ---- schema matching -----------------------------------------------------------------------------------

def _camel(c):
    parts = F.split(F.regexp_replace(c, "^[a-z]_", ""), "_")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 9), F.initcap), ""))


def _matched(spark, sf_dir):
    """The columns of customer without their prefix, against fields that repeat some of the names."""
    cols = tables.column_catalog(spark, {"customer": table(spark, sf_dir, "customer"), "supplier": table(spark, sf_dir, "supplier")}).withColumn("column_name", F.regexp_replace("column_name", "^[a-z]_", ""))
    fields = cols.where("table_name = 'customer'").select(F.concat(F.lit("$."), F.col("column_name")).alias("json_path"), F.col("column_name").alias("name"), F.col("column_comment").alias("comment"), F.col("data_type").alias("type"), F.lit(None).cast("boolean").alias("required"), F.col("ordinal_position").alias("field_ordinal"))
    return schema_match.best_candidates(schema_match.score_pairs(cols, fields))


@query("WITH c AS (SELECT table_name, regexp_replace(column_name, '^[a-z]_', '') AS n, data_type, ordinal_position AS p FROM information_schema.columns WHERE table_name IN ('customer', 'supplier')), f AS (SELECT n, data_type, p FROM c WHERE table_name = 'customer'), s AS (SELECT c.table_name, c.n AS column_name, f.n AS field, f.p, CASE WHEN c.n = f.n THEN 0.48 ELSE 0 END + CASE WHEN c.data_type = 'VARCHAR' OR (c.data_type IN ('BIGINT', 'INTEGER') AND f.data_type IN ('BIGINT', 'INTEGER')) OR (c.data_type = 'DOUBLE' AND f.data_type IN ('BIGINT', 'INTEGER', 'DOUBLE')) THEN 0.08 ELSE -0.12 END AS score FROM c, f), r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, p) AS rn FROM s) SELECT table_name, column_name, '$.' || field AS json_path, CASE WHEN score >= 0.55 THEN 'review' ELSE 'low' END AS confidence FROM r WHERE rn = 1")
def best_candidates(spark, sf_dir):
    return _matched(spark, sf_dir).select("table_name", "column_name", "json_path", "confidence")


@query("SELECT table_name, regexp_replace(column_name, '^[a-z]_', '') AS column_name, CASE data_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'decimal' ELSE 'string' END AS kind FROM information_schema.columns WHERE table_name = 'customer' OR (table_name = 'supplier' AND column_name IN ('s_name', 's_nationkey', 's_acctbal'))")
def draft_mappings(spark, sf_dir):
    return schema_match.draft_mappings(_matched(spark, sf_dir)).select("table_name", "column_name", "kind")


_PARTS_AS_FIELDS = "f AS (SELECT '$.' || p_partkey AS json_path, p_name AS comment, p_partkey AS o FROM part), c AS (SELECT p_partkey, p_name AS comment FROM part), tok AS (SELECT *, string_split(comment, ' ') AS t FROM c), ft AS (SELECT *, string_split(comment, ' ') AS u FROM f)"


@query(f"""WITH {_PARTS_AS_FIELDS}, s AS (SELECT p_partkey, json_path, o, least(1, CASE WHEN tok.comment = ft.comment THEN 0.72 WHEN contains(replace(tok.comment, ' ', ''), replace(ft.comment, ' ', '')) OR contains(replace(ft.comment, ' ', ''), replace(tok.comment, ' ', '')) THEN 0.58 ELSE 0.48 * len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) END + 0.08) AS score FROM tok, ft), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, o) AS rn FROM s)
    SELECT p_partkey, json_path, round(score, 6) AS score, CASE WHEN round(score, 6) >= 0.75 THEN 'high' WHEN round(score, 6) >= 0.55 THEN 'review' ELSE 'low' END AS confidence FROM r WHERE rn = 1""")
def match_comments(spark, sf_dir):
    """Every part as a column, by its comment, against every part as a field, by postings; all pairs give the same best ones."""
    p = table(spark, sf_dir, "part")
    none = lambda t: F.lit(None).cast(t)
    columns = p.select(F.lit("part").alias("table_name"), F.concat(F.lit("column"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij")).alias("column_name"), F.lit("varchar").alias("data_type"), F.col("p_name").alias("column_comment"), F.lit("YES").alias("is_nullable"), F.col("p_partkey").alias("ordinal_position"), none("int").alias("numeric_scale"))
    fields = p.select(F.concat(F.lit("$."), F.col("p_partkey")).alias("json_path"), F.concat(F.lit("f"), F.col("p_partkey")).alias("name"), F.col("p_name").alias("comment"), F.lit("string").alias("type"), none("boolean").alias("required"), F.col("p_partkey").alias("field_ordinal"))
    best = schema_match.best_candidates(schema_match.score_pairs(columns, fields, only_best=True))
    return best.select(F.col("ordinal_position").alias("p_partkey"), "json_path", "score", "confidence")


# ---- cases and suites ----------------------------------------------------------------------------------

def _raw_cases(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "signup", "skip").otherwise("Block")
    assertion = lambda j: F.struct(F.lit(f"check {j}").alias("check"), F.lit("1").alias("expected"), F.when(i % 11 != 0, "1").alias("actual"), (i % (7 + j) != 0).alias("passed"))
    return e.select(
        F.concat(F.when(i % 3 == 0, "GW-").otherwise("DEBUG-"), i).alias("id"), i.alias("ordinal"), F.when(i % 13 != 0, F.concat(F.lit("case "), i)).otherwise("").alias("title"), status.alias("status"),
        F.concat(F.lit("S"), F.col("user_id") % 4).alias("suite_id"), F.when(F.col("user_id") % 2 == 0, "api").otherwise("ui").alias("suite_type"), F.array(assertion(0), assertion(1)).alias("assertions"),
        F.when(i % 10 == 0, 5).alias("declared_assertions"), F.when(i % 4 != 0, F.array(F.lit("a.png"))).alias("screenshots"), F.when(i % 2 == 0, F.array(F.concat(F.lit("P"), i % 50))).otherwise(F.array().cast("array<string>")).alias("related_cases"),
    )


def _cases(spark, sf_dir):
    return rollup.normalize_cases(_raw_cases(spark, sf_dir))


_CASES = "c AS (SELECT event_id AS i, CASE WHEN event_id % 3 = 0 THEN 'GW-' ELSE 'DEBUG-' END || event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('view', 'click') THEN CASE WHEN event_id % 7 = 0 OR event_id % 8 = 0 THEN 'failed' ELSE 'passed' END WHEN event_type = 'signup' THEN 'skipped' ELSE 'blocked' END AS status, 'S' || (user_id % 4) AS suite_id, CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'ui' END AS suite_type, CASE WHEN event_id % 10 = 0 THEN 5 ELSE 2 END AS n_assertions, CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS n_screens, CAST(event_id % 7 <> 0 AS INT) + CAST(event_id % 8 <> 0 AS INT) AS n_passed FROM events)"
_COUNTS = "sum(n_screens) AS screenshots, sum(n_passed) AS passed_assertions, count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'skipped') AS skipped, sum(n_assertions) AS assertions, round(100.0 * count(*) FILTER (status = 'passed') / count(*), 2) AS pass_rate"
_KEPT = ["screenshots", "passed_assertions", "total", "passed", "failed", "blocked", "skipped", "assertions", "pass_rate"]


@query(f"WITH {_CASES} SELECT id, status, n_assertions FROM c")
def normalize_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("id", "status", "n_assertions")


@query(f"WITH {_CASES} SELECT suite_type, suite_id, {_COUNTS} FROM c GROUP BY 1, 2")
def suite_summary(spark, sf_dir):
    return rollup.suite_summary(_cases(spark, sf_dir), ["suite_type", "suite_id"]).select("suite_type", "suite_id", *_KEPT)


@query(f"WITH {_CASES} SELECT suite_type, suite_id, {_COUNTS} FROM c GROUP BY ROLLUP (suite_type, suite_id)")
def total_summary(spark, sf_dir):
    return rollup.total_summary(_cases(spark, sf_dir), ["suite_type", "suite_id"]).select("suite_type", "suite_id", *_KEPT)


@query(f"WITH {_CASES} SELECT suite_id, 'failed' AS conclusion, {_COUNTS} FROM c WHERE id LIKE 'GW-%' GROUP BY suite_id HAVING count(*) FILTER (status = 'failed') > 0 UNION ALL SELECT suite_id, CASE WHEN count(*) FILTER (status = 'blocked') > 0 THEN 'blocked' WHEN count(*) FILTER (status = 'skipped') > 0 THEN 'pass_with_risk' ELSE 'pass' END, {_COUNTS} FROM c WHERE id LIKE 'GW-%' GROUP BY suite_id HAVING count(*) FILTER (status = 'failed') = 0")
def core_summary(spark, sf_dir):
    return rollup.conclusion(rollup.core_summary(_cases(spark, sf_dir), ["GW-"], ["suite_id"])).select("suite_id", "conclusion", *_KEPT)


_POINTS = "l AS (SELECT CASE WHEN i % 2 = 0 THEN 'P' || (i % 50) ELSE id END AS point_id, id, status FROM c), a AS (SELECT point_id, count(DISTINCT id) AS n_cases, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'blocked') THEN 'blocked' WHEN bool_and(status = 'passed') THEN 'passed' WHEN bool_or(status = 'skipped') THEN 'skipped' ELSE 'unknown' END AS status FROM l GROUP BY 1)"


def _plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("point_id"), F.col("p_name").alias("title"))
    return p.withColumn("terms", F.split("title", " "))


@query(f"WITH {_CASES}, {_POINTS} SELECT point_id, n_cases, status, p_name AS title FROM a LEFT JOIN part ON point_id = 'P' || p_partkey")
def execution_matrix(spark, sf_dir):
    return rollup.execution_matrix(_cases(spark, sf_dir), _plan(spark, sf_dir))


@query(f"WITH {_CASES}, {_POINTS}, d AS (SELECT 'P' || (o_orderkey % 60) AS point_id, o_orderkey AS id FROM orders WHERE o_orderkey % 17 = 0), n AS (SELECT point_id, count(DISTINCT id) AS n FROM d GROUP BY 1) SELECT point_id, n_cases, coalesce(n, 0) AS n_defects FROM a LEFT JOIN n USING (point_id)")
def attach_defects(spark, sf_dir):
    defects = table(spark, sf_dir, "orders").where("o_orderkey % 17 = 0").select(F.array(F.concat(F.lit("P"), F.col("o_orderkey") % 60)).alias("related_cases"), F.col("o_orderkey").alias("defect_id"))
    return rollup.attach_defects(rollup.execution_matrix(_cases(spark, sf_dir), _plan(spark, sf_dir)), defects).select("point_id", "n_cases", "n_defects")


@query("SELECT 'P' || (event_id % 50) AS point_id, CASE WHEN event_id % 3 = 0 THEN 'GW-' ELSE 'DEBUG-' END || event_id AS case_id, 0 AS hits FROM events JOIN part ON p_partkey = event_id % 50 WHERE event_id % 2 = 0 AND NOT contains(CASE WHEN event_id % 13 <> 0 THEN 'case ' || event_id ELSE '' END, lower(string_split(p_name, ' ')[1])) AND NOT contains(CASE WHEN event_id % 13 <> 0 THEN 'case ' || event_id ELSE '' END, lower(string_split(p_name, ' ')[2]))")
def mapping_warnings(spark, sf_dir):
    return gates.mapping_warnings(_plan(spark, sf_dir), _raw_cases(spark, sf_dir))


@query(f"WITH {_CASES} SELECT c.id, problem FROM (SELECT id, 'no_title' AS problem FROM c WHERE i % 13 = 0 UNION ALL SELECT id, 'incomplete_assertion' FROM c WHERE i % 11 = 0 UNION ALL SELECT c.id, 'passed_with_failed_assertion' FROM c JOIN events e ON e.event_id = i WHERE event_type IN ('view', 'click') AND (i % 7 = 0 OR i % 8 = 0) UNION ALL SELECT c.id, 'failed_without_screenshot' FROM c JOIN events e ON e.event_id = i WHERE event_type = 'error' AND i % 4 = 0) c")
def check_cases(spark, sf_dir):
    from ..functions.normalize import norm_status

    return gates.check_cases(_raw_cases(spark, sf_dir).withColumn("status", norm_status(F.col("status"))))


@query(f"WITH {_CASES}, s AS (SELECT suite_id, count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM c GROUP BY 1) SELECT suite_id, 'total' AS measure, total + 1 AS declared, total AS computed FROM s WHERE suite_id = 'S1'")
def check_counts(spark, sf_dir):
    s = rollup.suite_summary(_cases(spark, sf_dir), ["suite_id"])
    declared = s.withColumn("total", F.when(F.col("suite_id") == "S1", F.col("total") + 1).otherwise(F.col("total")))
    return gates.check_counts(declared, s, ["suite_id"], ["total", "failed"])


@query("SELECT o_orderkey, 'priority' AS \"column\" FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderkey % 10 = 0")
def check_required(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 10 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"))
    return gates.check_required(o, ["priority", "status"], ["o_orderkey"])


@query("SELECT event_id, event_type AS value FROM events WHERE event_type NOT IN ('view', 'click', 'signup')")
def check_enum(spark, sf_dir):
    return gates.check_enum(table(spark, sf_dir, "events"), "event_type", ["view", "click", "signup"], ["event_id"])


@query(f"WITH {_CASES}, v AS (SELECT 'failed' AS check_name, count(*) FILTER (status = 'failed') AS value, 10 AS soft, 1000000 AS hard FROM c UNION ALL SELECT 'unknown', count(*) FILTER (status = 'unknown'), 0, 0 FROM c) SELECT check_name, value, CASE WHEN value > hard THEN 'FAIL' WHEN value > soft THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN max(CASE WHEN value > hard THEN 2 WHEN value > soft THEN 1 ELSE 0 END) OVER () = 2 THEN 'FAIL' WHEN max(CASE WHEN value > hard THEN 2 WHEN value > soft THEN 1 ELSE 0 END) OVER () = 1 THEN 'WARN' ELSE 'PASS' END AS gate FROM v")
def gate(spark, sf_dir):
    c = _cases(spark, sf_dir)
    one = lambda s, soft, hard: c.agg(F.lit(s).alias("check_name"), F.count_if(F.col("status") == s).alias("value"), F.lit(soft).alias("soft"), F.lit(hard).alias("hard"))
    return gates.gate(one("failed", 10, 1_000_000).union(one("unknown", 0, 0)))


# ---- interfaces -------------------------------------------------------------------------------------------

def _accuracy(spark, sf_dir):
    """Parts as accuracy records: interface by type, field by name, status by size."""
    status = F.get(F.array(*[F.lit(x) for x in ("PASS", "PASS", "WARN", "BLOCKED", "FAIL")]), F.least(F.lit(4), F.col("p_size") % 40))
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("interface_name"), F.concat_ws("", "p_type", "p_brand").alias("path"), F.col("p_name").alias("target_field"), F.when(F.col("p_size") % 40 > 4, "PASS").otherwise(status).alias("status"), "p_partkey", "p_brand")


_ACC = "acc AS (SELECT p_type AS interface_name, p_name AS target_field, p_partkey, p_brand, CASE p_size % 40 WHEN 2 THEN 'WARN' WHEN 3 THEN 'BLOCKED' WHEN 4 THEN 'FAIL' ELSE 'PASS' END AS status FROM part)"
_WORST = "CASE min(CASE status WHEN 'FAIL' THEN 0 WHEN 'BLOCKED' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END) WHEN 0 THEN 'FAIL' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'WARN' ELSE 'PASS' END"


@query(f"WITH {_ACC} SELECT interface_name, target_field, {_WORST} AS status FROM acc GROUP BY 1, 2")
def worst_status(spark, sf_dir):
    return rollup.worst_status(_accuracy(spark, sf_dir), ["interface_name", "target_field"])


@query(f"WITH {_ACC}, o AS (SELECT {_WORST} AS status, count(*) AS n FROM acc WHERE status IN ('PASS', 'WARN')) SELECT status, n, CASE WHEN status = 'WARN' THEN 'PASS' ELSE status END AS status3 FROM o")
def overall(spark, sf_dir):
    return rollup.overall(_accuracy(spark, sf_dir).where(F.col("status").isin("PASS", "WARN")))


@query(f"WITH {_ACC}, a AS (SELECT interface_name, count(DISTINCT target_field) AS field_total, count(*) AS fields_validated, count(*) FILTER (status = 'FAIL') AS fail_fields, count(*) FILTER (status = 'BLOCKED') AS blocked_fields FROM acc GROUP BY 1), r AS (SELECT interface_name, count(*) AS fields_with_rules FROM acc WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT interface_name, field_total, coalesce(fields_with_rules, 0) AS fields_with_rules, fields_validated, fail_fields, blocked_fields, 0 AS na_fields FROM a LEFT JOIN r USING (interface_name)")
def field_counts(spark, sf_dir):
    a = _accuracy(spark, sf_dir)
    return rollup.field_counts(a.where("p_partkey % 2 = 0"), a)


@query(f"WITH {_ACC}, a AS (SELECT interface_name, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'BLOCKED') AS b, count(*) FILTER (status = 'WARN') AS w, count(*) FILTER (p_partkey % 100 = 0) AS g, count(*) FILTER (p_partkey % 50 = 0) AS d FROM acc GROUP BY 1) SELECT interface_name, g AS n_gaps, d AS n_differences, CASE WHEN f > 0 THEN 'FAIL' WHEN b > 0 OR g > 0 THEN 'BLOCKED' WHEN w > 0 OR d > 0 THEN 'WARN' ELSE 'PASS' END AS computed, CASE WHEN interface_name LIKE 'E%' THEN 'WARN' WHEN f > 0 THEN 'FAIL' WHEN b > 0 OR g > 0 THEN 'BLOCKED' WHEN w > 0 OR d > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM a")
def interface_status(spark, sf_dir):
    a = _accuracy(spark, sf_dir)
    inventory = a.select("interface_name").distinct().withColumn("declared", F.when(F.col("interface_name").startswith("E"), "WARN"))
    return rollup.interface_status(inventory, a, a.where("p_partkey % 100 = 0"), a.where("p_partkey % 50 = 0")).select("interface_name", "n_gaps", "n_differences", "computed", "status")


@query("SELECT DISTINCT p_type AS interface_name FROM part UNION SELECT DISTINCT c_mktsegment FROM customer")
def interface_names(spark, sf_dir):
    return rollup.interface_names(_accuracy(spark, sf_dir), table(spark, sf_dir, "customer").select(F.lit("").alias("interface_name"), F.col("c_mktsegment").alias("interface_path")))


@query("WITH r AS (SELECT p_type AS interface_name, p_name AS reason, min(p_partkey) AS ordinal FROM part GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY interface_name ORDER BY ordinal, reason) AS place FROM r) SELECT interface_name, place, reason FROM o WHERE place <= 3")
def interface_reasons(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_type").alias("interface_name"), F.col("p_name").alias("reason"), F.col("p_partkey").alias("ordinal"))
    return rollup.interface_reasons(a.where("ordinal % 2 = 0"), a.where("ordinal % 2 = 1"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_batches, count(*) FILTER (event_type <> 'error') AS n_success, sum(event_id % 100) AS total_count, sum(CASE WHEN event_type = 'error' THEN event_id % 100 ELSE 0 END) AS failed_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_start, CASE WHEN bool_or(event_id % 211 = 0) THEN 'open' ELSE strftime(max(ts), '%Y-%m-%d %H:%M:%S') END AS last_end, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes FROM events GROUP BY strftime(ts, '%Y-%m-%d')")
def batch_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 100
    b = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), n.alias("total_count"), F.when(F.col("event_type") == "error", n).otherwise(0).alias("failed_count"), F.col("ts").alias("start_time"), F.when(F.col("event_id") % 211 != 0, F.col("ts")).alias("end_time"), F.col("event_type").alias("code"))
    return rollup.batch_summary(b, ["day"])


@query(f"WITH {_ACC}, f AS (SELECT DISTINCT p_brand AS field_name FROM part), x AS (SELECT field_name, target_field AS record, status, 1 AS e FROM f JOIN (SELECT p_brand || ', ' || target_field AS target_field, p_brand, status FROM acc) a ON a.p_brand = field_name), r AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY e, CASE status WHEN 'FAIL' THEN 0 WHEN 'BLOCKED' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END, record) AS rn FROM x) SELECT field_name, record, status FROM r WHERE rn = 1")
def accuracy_for_fields(spark, sf_dir):
    a = _accuracy(spark, sf_dir).select(F.concat_ws(", ", "p_brand", "target_field").alias("target_field"), "status", "p_brand")
    return rollup.accuracy_for_fields(a.select(F.col("p_brand").alias("field_name")).distinct(), a.drop("p_brand")).select("field_name", "record", "status")


@query("SELECT p_partkey AS rule_id, 'parts' AS target_table, p_brand AS target_column FROM part UNION ALL SELECT p_partkey, 'orders', string_split(p_name, ' ')[1] FROM part")
def rule_targets(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.concat(F.col("p_brand"), F.lit(", orders."), F.split("p_name", " ")[0], F.lit("; map_helper.x")).alias("target_text"))
    return rollup.rule_targets(rules, "parts", ["map_helper"])


@query("SELECT c_custkey AS target_field, 'a' AS source_field, 'rule' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'b', 'rule' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'hinted', 'hint' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, r_name, 'all' FROM customer, region WHERE c_custkey % 3 = 2")
def target_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_field"))
    rules = c.withColumn("source_text", F.when(F.col("target_field") % 3 == 0, "a, b").otherwise(""))
    hints = c.where("target_field % 3 = 1").withColumn("source_field", F.lit("hinted"))
    return rollup.target_sources(rules, hints, table(spark, sf_dir, "region").select(F.col("r_name").alias("source_field")))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'View' WHEN user_id % 2 = 0 THEN 'Even' ELSE event_type END AS display_name FROM events")
def resolve_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("interface_name"), (F.col("user_id") % 2).cast("string").alias("interface_path"))
    inventory = spark.createDataFrame([("view", None, "View", 0), ("view", None, "Other", 1), (None, "0", "Even", 2)], "interface_name string, interface_path string, display_name string, ordinal int")
    return rollup.resolve_names(e, inventory).select("event_id", "display_name")


@query("SELECT p_type AS interface_name, 'differences_without_sample' AS problem FROM part GROUP BY 1 HAVING count(*) FILTER (p_size = 50) = 0 UNION ALL SELECT p_type, 'pass_without_rules' FROM part GROUP BY 1 HAVING count(*) FILTER (p_size = 49) = 0 UNION ALL SELECT p_type, 'pass_without_accuracy' FROM part GROUP BY 1 HAVING count(*) FILTER (p_size = 48) = 0")
def check_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("interface_name"), "p_size", F.lit("seen").alias("difference_note"))
    results = p.select("interface_name").distinct().select("interface_name", F.lit("PASS").alias("status"), F.lit("").alias("evidence"), F.lit(1).alias("n_differences"))
    return gates.check_evidence(results, p.where("p_size = 49"), p.where("p_size = 48"), p.where("p_size = 50"))


@query("SELECT doc_id FROM documents WHERE source = 'src1' OR lang = 'de' ")
def for_interface(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("interface_name"), F.when(F.col("lang") == "de", "src7, src1").otherwise("src11").alias("scope"))
    return responses.for_interface(d, "src1").select("doc_id")


@query("SELECT business_key, field_name FROM (SELECT p_partkey AS business_key, unnest(string_split(p_name, ' ')) AS field_name FROM part) WHERE field_name IN ('red', 'blue', 'ring')")
def samples_for_fields(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_key"), F.regexp_replace("p_name", " ", ", ").alias("difference_field"))
    return rollup.samples_for_fields(spark.createDataFrame([("red",), ("blue",), ("ring",)], "field_name string"), s).select("business_key", "field_name")


# ---- captured responses ------------------------------------------------------------------------------

@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 400000 AND NOT (o_orderstatus = 'O')")
def filter_violations(spark, sf_dir):
    return responses.filter_violations(table(spark, sf_dir, "orders").where("o_totalprice < 400000"), F.col("o_orderstatus") == "O").select("o_orderkey")


@query("SELECT o_orderkey, 'repeated' AS finding FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey % 307 <> 0 UNION ALL SELECT o_orderkey, 'never_returned' FROM orders WHERE o_orderkey % 307 = 0")
def paging_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 100).alias("page"), (F.col("o_orderkey") % 100).alias("position"))
    kept = o.where("o_orderkey % 307 <> 0")
    return responses.paging_check(kept.union(kept.where("o_orderkey % 100 = 0").withColumn("page", F.col("page") + 1)), o, "o_orderkey")


@query("WITH r AS (SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS s, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS t FROM customer) SELECT c_custkey AS custkey, CASE WHEN s AND NOT t THEN 'FAIL' ELSE 'PASS' END AS status FROM r")
def check_empty_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return responses.check_empty_lists(requests, o.where("o_orderstatus = 'F'"), o, ["custkey"]).select("custkey", "status")


# ---- pages ----------------------------------------------------------------------------------------------

_LINK = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href FROM pages)"""


@query(f"WITH {_LINK} SELECT page_id, href FROM l")
def page_links(spark, sf_dir):
    return pages.page_links(pages.page_nodes(table(spark, sf_dir, "pages"), need=("tag", "text", "attrs"), tags=("a", "button"), dealt=False)).select("page_id", "href")


def _decoded(text: str) -> str:
    """The character references of the given pages as a browser reads them: these names count without their semicolon too, as where a text was cut."""
    for name, of in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{of}', 'g')"
    return text


_TITLE = _decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(rf"SELECT page_id, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return pages.page_title(pages.page_nodes(table(spark, sf_dir, "pages"), need=("tag", "text"), tags=("title", "h1"), dealt=False))


@query("SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>'), '<[a-z]')) AS n_nodes, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<h1')) AS n_headings, 0 AS n_tables FROM pages")
def page_stats(spark, sf_dir):
    return pages.page_stats(pages.page_nodes(table(spark, sf_dir, "pages"), need=("tag",), dealt=False)).select("page_id", "n_nodes", "n_links", "n_headings", "n_tables")


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') AS base_url, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '-') AS page FROM pages")
def page_url_parts(spark, sf_dir):
    return pages.page_url_parts(table(spark, sf_dir, "pages")).select("page_id", "host", "base_url", F.coalesce(F.try_element_at("params", F.lit("page")), F.lit("-")).alias("page"))


@query(f"WITH {_LINK} SELECT l.page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || regexp_replace(href, '#.*$', '') AS target_url FROM l JOIN pages USING (page_id)")
def resolve_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return pages.resolve_links(pages.page_links(pages.page_nodes(p, need=("tag", "text", "attrs"), tags=("a", "button"), dealt=False)), p).select("page_id", "target_url")


_VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '</?(p|li|ul|nav|div|h1|article|footer|br)( [^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')"""


@query(rf"""SELECT page_id, md5(trim(regexp_replace({_decoded(_VISIBLE)}, '\s+', ' ', 'g'))) AS digest FROM pages""")
def page_text(spark, sf_dir):
    nodes = pages.page_nodes(table(spark, sf_dir, "pages"), need=("parent_id", "text"), tags=("html",), dealt=False)
    return pages.page_text(nodes).select("page_id", F.md5("text").alias("digest"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/b' AS up, regexp_extract(url, '^([a-z]+:)', 1) || '//other.host/x' AS other FROM pages")
def resolve_relative_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.lit("/d/e/page.html?x=1")).alias("url"))
    links = p.select("page_id", F.posexplode(F.array(F.lit(".././../b#f"), F.lit("//other.host/x"))).alias("node_id", "href"))
    out = pages.resolve_links(links, p)
    return out.groupBy("page_id").agg(F.max(F.when(F.col("node_id") == 0, F.col("target_url"))).alias("up"), F.max(F.when(F.col("node_id") == 1, F.col("target_url"))).alias("other"))


def _elements(spark, sf_dir):
    return locators.page_elements(pages.page_nodes(table(spark, sf_dir, "pages")))


@query(f"WITH {_LINK}, n AS (SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2) SELECT page_id, 'a[href=\"' || href || '\"]' AS value, n = 1 AS \"unique\" FROM l JOIN n USING (page_id, href)")
def locator_candidates(spark, sf_dir):
    found = locators.locator_candidates(_elements(spark, sf_dir).where(F.size("reasons") > 0))
    return found.where("strategy = 'css'").select("page_id", "value", "unique")


@query(f"WITH {_LINK} SELECT count(*) AS n_links FROM l")
def interactive_elements(spark, sf_dir):
    return _elements(spark, sf_dir).where(F.array_contains("reasons", "href")).agg(F.count("*").alias("n_links"))


@query("SELECT event_type AS element, CASE WHEN min(ok) = 1 THEN 'PASS' WHEN max(ok) = 1 THEN 'WARN' ELSE 'FAIL' END AS status, min(ok) = 1 AS chosen, CASE WHEN min(ok) = 0 AND max(ok) = 1 THEN 'state-dependent,i18n-sensitive' ELSE 'i18n-sensitive' END AS risks FROM (SELECT event_type, user_id % 3 AS state, max(CASE WHEN event_type <> 'error' AND (event_type <> 'click' OR user_id % 3 > 0) THEN 1 ELSE 0 END) AS ok FROM events GROUP BY 1, 2) GROUP BY 1")
def locator_stability(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = (F.col("event_type") != "error") & ((F.col("event_type") != "click") | (F.col("user_id") % 3 > 0))
    states = e.select(F.col("event_type").alias("element"), (F.col("user_id") % 3).alias("state"), F.lit("label").alias("strategy"), F.col("event_type").alias("value"), F.lit(True).alias("unique"), ok.alias("visible"), F.lit(True).alias("operable")).distinct()
    return locators.locator_stability(states).select("element", "status", "chosen", "risks")


# ---- pages made of suppliers: tables, forms and dialogs, which the given pages lack ------------------------

def _forms(spark, sf_dir):
    """A page for each supplier with a requirement table, notes, a form, a dialog and buttons."""
    k, name, nation = F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")
    html = F.concat(
        F.lit("<html><body><nav class='menu'><a href='/home'>Home</a></nav><h2>Rules</h2><table><tr><th>版本</th><th>版本内容</th><th>说明</th></tr><tr><td>V1."), nation % 3,
        F.lit("</td><td>1. Item "), k % 5, F.lit("</td><td><ul><li>one "), name, F.lit("</li><li>two</li></ul></td></tr><tr><td>V9+V1.0</td><td>Item "), k % 5, F.lit(" </td><td>Short.</td></tr></table><h3>Hints</h3><p class='tip'>Mind "), name,
        F.lit("</p><p class='tip'>Mind "), name, F.lit("</p><form><label for='f1'>Full name</label><input id='f1' type='text'><input name='age' type='number'><select name='kind'><option>a</option></select></form><div class='modal'><h4>Confirm "), k,
        F.lit("</h4><input name='why'><button data-testid='ok"), k % 2, F.lit("'>OK</button><button id='el-id-12-3'>Cancel</button></div><div style='display: none'><button>Ghost</button></div></body></html>"),
    )
    return spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("page_id"), html.alias("html"))


def _form_nodes(spark, sf_dir):
    return pages.page_nodes(_forms(spark, sf_dir))


@query("SELECT s_suppkey AS page_id, r.i AS row, c.j AS cell, CASE r.i WHEN 0 THEN CASE c.j WHEN 0 THEN '版本' WHEN 1 THEN '版本内容' ELSE '说明' END WHEN 1 THEN CASE c.j WHEN 0 THEN 'V1.' || s_nationkey % 3 WHEN 1 THEN '1. Item ' || s_suppkey % 5 ELSE 'one ' || s_name || ' two' END ELSE CASE c.j WHEN 0 THEN 'V9+V1.0' WHEN 1 THEN 'Item ' || s_suppkey % 5 ELSE 'Short.' END END AS text, r.i = 0 AS is_header FROM supplier, range(0, 3) r(i), range(0, 3) c(j)")
def page_tables(spark, sf_dir):
    return pages.page_tables(_form_nodes(spark, sf_dir)).select("page_id", "row", "cell", "text", "is_header")


@query("SELECT s_suppkey AS page_id, CASE WHEN s_nationkey % 3 = 0 THEN 'one ' || s_name || '|two' ELSE 'Short' END AS notes, CASE WHEN s_nationkey % 3 = 0 THEN 'exact' ELSE 'mixed' END AS version_match FROM supplier")
def requirement_rows(spark, sf_dir):
    return pages.requirement_rows(_form_nodes(spark, sf_dir), "1.0").select("page_id", F.array_join("notes", "|").alias("notes"), "version_match")


@query("WITH r AS (SELECT s_suppkey AS page_id, s_suppkey % 5 AS item, CASE WHEN s_nationkey % 3 = 0 THEN length('one ' || s_name || 'two') ELSE 5 END AS n FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, page_id) AS rn, count(*) OVER (PARTITION BY item) AS n_copies FROM r) SELECT page_id, n_copies FROM o WHERE rn = 1")
def merge_requirements(spark, sf_dir):
    return pages.merge_requirements(pages.requirement_rows(_form_nodes(spark, sf_dir), "1.0")).select("page_id", "n_copies")


@query("SELECT s_suppkey AS page_id, 'Mind ' || s_name AS note, 'Hints' AS section FROM supplier")
def page_notes(spark, sf_dir):
    return pages.page_notes(_form_nodes(spark, sf_dir)).select("page_id", "note", "section")


@query("SELECT s_suppkey AS page_id, name, tag FROM supplier, (VALUES ('Full name', 'input'), ('age', 'input'), ('kind', 'select'), ('why', 'input')) v(name, tag)")
def page_fields(spark, sf_dir):
    return pages.page_fields(_form_nodes(spark, sf_dir)).select("page_id", "name", "tag")


@query("SELECT s_suppkey AS page_id, 'Confirm ' || s_suppkey AS title, 1 AS n_fields, 'OK,Cancel' AS actions FROM supplier")
def page_interactions(spark, sf_dir):
    return pages.page_interactions(_form_nodes(spark, sf_dir)).select("page_id", "title", "n_fields", "actions")


@query("SELECT s_suppkey AS page_id, kind AS business_type, n FROM supplier, (VALUES ('table_column', 3), ('text_input', 4), ('number_input', 1), ('select', 1), ('action_button', 2)) v(kind, n)")
def business_elements(spark, sf_dir):
    found = locators.business_elements(locators.page_elements(_form_nodes(spark, sf_dir)))
    return found.groupBy("page_id", "business_type").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS page_id, 'OK' AS name, 'test_id' AS strategy, 'ok' || s_suppkey % 2 AS value FROM supplier UNION ALL SELECT s_suppkey, 'Cancel', 'role', 'button|Cancel' FROM supplier")
def rank_locators(spark, sf_dir):
    e = locators.business_elements(locators.page_elements(_form_nodes(spark, sf_dir))).where("business_type = 'action_button'")
    best = locators.rank_locators(locators.locator_strategies(locators.locator_candidates(e)))
    return best.join(e.select("page_id", "node_id", "name"), ["page_id", "node_id"]).select("page_id", "name", "strategy", "value")


@query("SELECT s_suppkey AS page_id, unique_name FROM supplier, (VALUES ('action_button_confirm'), ('action_button_cancel')) v(unique_name)")
def element_names(spark, sf_dir):
    e = locators.business_elements(locators.page_elements(_form_nodes(spark, sf_dir))).where("business_type = 'action_button'")
    return locators.element_names(e).select("page_id", "unique_name")


_PLACES = "(VALUES ('OK', '/html[1]/body[1]/div[1]/button[1]'), ('Cancel', '/html[1]/body[1]/div[1]/button[2]')) v(name, value)"


@query(f"SELECT s_suppkey AS page_id, name, value, true AS \"unique\" FROM supplier, {_PLACES}")
def locator_xpaths(spark, sf_dir):
    every = locators.page_elements(_form_nodes(spark, sf_dir))
    e = locators.business_elements(every).where("business_type = 'action_button'")
    found = locators.locator_candidates(e, every).where("strategy = 'xpath'")
    return found.join(e.select("page_id", "node_id", "name"), ["page_id", "node_id"]).select("page_id", "name", "value", "unique")


@query("SELECT s_suppkey AS page_id, '#box' || s_suppkey || ' button.main.wide' AS value, s_suppkey % 2 = 0 AS \"unique\" FROM supplier WHERE NOT regexp_matches('box' || s_suppkey, '[0-9]{5,}$')")
def locator_scoped(spark, sf_dir):
    """A container whose id ends in five digits or more counts as numbered anew (``is_dynamic_id``), so it scopes nothing."""
    k = F.col("s_suppkey")
    html = F.concat(F.lit("<div id='box"), k, F.lit("'><p><button class='el-button main wide'>Go</button></p>"), F.when(k % 2 == 1, "<i><button class='wide-not'>No</button><b><button class='main wide'>Again</button></b></i>").otherwise(""), F.lit("</div>"))
    every = locators.page_elements(pages.page_nodes(spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("page_id"), html.alias("html"))))
    found = locators.locator_candidates(every.where("text = 'Go' and tag = 'button'"), every)
    return found.where("strategy = 'scoped'").select("page_id", "value", "unique")


@query("SELECT s_suppkey AS page_id, 1 AS n_triggers FROM supplier WHERE s_suppkey % 3 = 0")
def interaction_warnings(spark, sf_dir):
    k = F.col("s_suppkey")
    html = F.concat(F.lit("<p><button aria-haspopup='dialog'>More</button></p>"), F.when(k % 3 != 0, "<div role='dialog'><h3>T</h3></div>").otherwise(""))
    return pages.interaction_warnings(pages.page_nodes(spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("page_id"), html.alias("html"))))


@query("SELECT s_suppkey AS page_id, 1 AS n_requirements, 1 AS n_notes, 1 AS n_interactions, 3 AS n_buttons FROM supplier")
def page_summary(spark, sf_dir):
    n = _form_nodes(spark, sf_dir)
    return pages.page_summary(n, pages.requirement_rows(n, "1.0"), pages.page_notes(n), pages.page_interactions(n)).select("page_id", "n_requirements", "n_notes", "n_interactions", "n_buttons")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'first ' || p_brand ELSE p_brand END AS field_alias FROM part WHERE p_type <> 'SMALL'")
def resolve_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_type <> 'SMALL'").select("p_partkey", F.col("p_type").alias("interface_name"), F.concat_ws("-", "p_brand", F.col("p_size") % 2).alias("field_name"), "p_brand", "p_size")
    alias = lambda word, at, when: p.where(when).select("interface_name", "field_name", F.concat(F.lit(word), F.col("p_brand")).alias("alias"), F.lit(at).alias("ordinal"))
    rules = alias("first ", 1, "p_size % 2 = 0").union(alias("later ", 2, "p_size % 2 = 0")).union(alias("", 3, "p_size % 2 = 1"))
    return rollup.resolve_fields(p.select("p_partkey", "interface_name", "field_name"), rules).select("p_partkey", "field_alias")


@query("SELECT 'id' AS strategy, count(*) AS total, count(*) AS pass, 0 AS fail FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'text', count(*), 0, count(*) FROM supplier WHERE s_suppkey % 2 = 1")
def locator_summary(spark, sf_dir):
    odd = F.col("s_suppkey") % 2 == 1
    s = table(spark, sf_dir, "supplier").select(F.when(odd, "text").otherwise("id").alias("strategy"), F.when(odd, "FAIL").otherwise("PASS").alias("status"))
    return locators.locator_summary(s, ["strategy"]).select("strategy", "total", "pass", "fail")


# ---- sources ------------------------------------------------------------------------------------------

@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey < 10")
def read_source(spark, sf_dir):
    spec = tables.SourceSpec("parquet", f"{sf_dir}/supplier.parquet", id_column="s_suppkey", extra=(("s_name", "name"), ("s_name", "NAME")), where="s_nationkey < 10")
    return tables.read_source(spark, spec).withColumnRenamed("s_suppkey", "id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'n' || s_nationkey END AS comment FROM supplier")
def load_catalog(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("description"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("remark"))
    return tables.load_catalog(s, {"id": ["s_suppkey"], "comment": ["comment", "description", "remark"]}).select(F.col("id").cast("long").alias("id"), "comment")


@query("SELECT n_nationkey AS id, 1 AS row, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation UNION ALL SELECT n_nationkey, 2, 'x', '' FROM nation")
def markdown_table_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("intro\n| Field Name | Home_Region |\n|---|:--:|\n| "), F.col("n_name"), F.lit(" | "), F.col("n_regionkey"), F.lit(" |\n| x |  |\nend"))
    rows = tables.markdown_table_rows(n.select(F.col("n_nationkey").alias("id"), text.alias("t")), "t", {"name": ["fieldname"], "region": ["region"]}, ["id"])
    return rows.select("id", "row", "name", "region")


@query("SELECT s_suppkey AS suite_id, CASE WHEN s_suppkey % 4 = 3 THEN 'no readable result' END AS reason, CASE WHEN s_suppkey % 4 <> 3 THEN 'T' || s_suppkey END AS id, CASE WHEN s_suppkey % 4 <> 3 THEN 1 END AS n_failed, CASE WHEN s_suppkey % 4 <> 3 THEN 'a.png,b.png' END AS shots, CASE WHEN s_suppkey % 4 <> 3 THEN 'P' || s_suppkey END AS related FROM supplier")
def load_suites(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suite_id"))
    case = F.concat(F.lit('[{"id": "T'), F.col("suite_id"), F.lit('", "status": "ok", "assertions": [{"check": "a", "expected": "1", "passed": true}, {"check": "b", "passed": false}], "screenshots": [{"path": "a.png"}, "b.png"], "related_cases": ["P'), F.col("suite_id"), F.lit('"]}]'))
    k = F.col("suite_id") % 4
    content = F.when(k == 0, F.concat(F.lit('{"cases": '), case, F.lit("}"))).when(k == 1, F.concat(F.lit('{"items": '), case, F.lit("}"))).when(k == 2, case).otherwise("broken{")
    out = tables.load_suites(s, s.select("suite_id", content.alias("content")))
    failed = F.when(F.col("assertions").isNotNull(), F.size(F.filter("assertions", lambda a: ~a["passed"])))
    return out.select("suite_id", "reason", "id", failed.alias("n_failed"), F.array_join("screenshots", ",").alias("shots"), F.array_join("related_cases", ",").alias("related"))


# ---- catalogue helpers --------------------------------------------------------------------------------

def _keyed_catalog(spark, sf_dir):
    """The catalogue with keys and defaults set by rule: key columns are primary, dates default to now, names must be given."""
    c = _catalog(spark, sf_dir)
    name = F.col("column_name")
    return c.withColumn("is_primary", F.col("ordinal_position") == 0).withColumn("column_default", F.when(name.contains("date"), "CURRENT_TIMESTAMP")).withColumn("is_nullable", ~name.contains("name"))


@query(f"SELECT table_name, column_name, 'full' AS mode {_COLUMNS} AND ordinal_position > 1 AND NOT contains(column_name, 'date') UNION ALL SELECT table_name, column_name, 'minimal' {_COLUMNS} AND ordinal_position > 1 AND contains(column_name, 'name') UNION ALL SELECT table_name, column_name, 'custom' {_COLUMNS} AND column_name = 'o_orderkey'")
def insert_columns(spark, sf_dir):
    c = _keyed_catalog(spark, sf_dir)
    pick = lambda mode, named=(): datagen.insert_columns(c, mode, list(named)).select("table_name", "column_name", F.lit(mode).alias("mode"))
    return pick("full").union(pick("minimal")).union(pick("custom", ["o_orderkey"]))


@query(f"SELECT table_name, column_name, CASE data_type WHEN 'VARCHAR' THEN substr('TEST_' || upper(column_name) || '_' || ordinal_position, 1, 12) WHEN 'DOUBLE' THEN ordinal_position || '.00' WHEN 'TIMESTAMP' THEN '2024-01-01 00:00:00' ELSE CAST(ordinal_position AS VARCHAR) END AS value {_COLUMNS}")
def fallback_value(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    value = datagen.fallback_value(F.col("data_type"), F.col("column_name"), F.col("ordinal_position"), F.lit(12))
    return c.select("table_name", "column_name", value.alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '$.lines[*].' || p_brand ELSE '$.' || p_brand END AS json_path, CASE WHEN p_partkey % 3 = 0 THEN '$.' || p_brand END AS relative_path FROM part")
def scope_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "$.lines[*].").otherwise("$."), F.col("p_brand")).alias("json_path"))
    head, detail = schema_match.scope_fields(f, "$.lines")
    return head.withColumn("relative_path", F.lit(None).cast("string")).unionByName(detail)


@query("SELECT table_name, regexp_replace(column_name, '^[a-z]_', '') AS column_name FROM information_schema.columns WHERE (table_name = 'customer' AND column_name = 'c_custkey') OR (table_name = 'supplier' AND column_name = 's_nationkey')")
def infer_keys(spark, sf_dir):
    drafted = schema_match.draft_mappings(_matched(spark, sf_dir))
    return schema_match.infer_keys(drafted, ("custkey", "suppkey", "nationkey")).select("table_name", "column_name")


@query("SELECT 'supplier' AS table_name, 'f:' || regexp_replace(column_name, '^c_', '') AS what FROM information_schema.columns WHERE table_name = 'customer' AND column_name = 'c_mktsegment'")
def unmatched_fields(spark, sf_dir):
    best = _matched(spark, sf_dir).where("table_name = 'supplier'")
    fields = _matched(spark, sf_dir).where("table_name = 'customer'").select("json_path").distinct()
    _, left = schema_match.unmatched(best, fields)
    return left.select(F.lit("supplier").alias("table_name"), F.concat(F.lit("f:"), F.substring("json_path", 3, 99)).alias("what"))


@query("SELECT event_id, '<redacted>' AS token, '3' AS token_count, event_type AS kind FROM events")
def redact_map(spark, sf_dir):
    from ..functions.redact import redact_map as redacted

    m = redacted(F.create_map(F.lit("access_token"), F.lit("abc"), F.lit("token_count"), F.lit("3"), F.lit("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").withColumn("m", m).select("event_id", F.col("m")["access_token"].alias("token"), F.col("m")["token_count"].alias("token_count"), F.col("m")["kind"].alias("kind"))
