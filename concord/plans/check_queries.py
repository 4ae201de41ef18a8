"""Digest trees, keys, causes and profiles over the given tables."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from ..functions import redact
from ..functions.normalize import FieldRule
from ..operators import causes, datagen, digest_tree, gates, keys, locators, pages, profiles, reconcile, schema_match
from ..sources import lookup, runs
from ..sources.shared import shared_dir
from .fixtures import ORDER_RULES, orders, spread, table
from .registry import query

# ---- digest trees: few rows differ, some keys repeat on both sides alike ------------------------------


def _sparse(spark, sf_dir):
    base, k = orders(spark, sf_dir), F.col("k")
    twice = base.union(base.where(k % 3989 == 1))
    price = F.when(k % 997 == 0, F.col("price") + F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("price")).cast("decimal(18,2)")
    changed = twice.where(k % 2999 != 0).withColumn("price", price)
    return twice, changed.union(base.where(k % 4001 == 0)).union(base.where(k % 3001 == 0).withColumn("k", -(k + 1)))


_SPARSE = """
    ob AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2)) AS price, o_orderpriority AS priority FROM orders),
    os AS (SELECT * FROM ob UNION ALL SELECT * FROM ob WHERE k % 3989 = 1),
    ot AS (SELECT k, status, CASE WHEN k % 997 = 0 THEN CAST(price + 0.01 AS DECIMAL(18,2)) ELSE price END AS price, priority FROM os WHERE k % 2999 <> 0 UNION ALL SELECT * FROM ob WHERE k % 4001 = 0 UNION ALL SELECT -(k + 1), status, price, priority FROM ob WHERE k % 3001 = 0),
    sn AS (SELECT k, count(*) AS n FROM os GROUP BY k), tn AS (SELECT k, count(*) AS n FROM ot GROUP BY k)"""


@query(f"""WITH {_SPARSE} SELECT 'ORDER_TARGET_MISSING' AS diff_type, CAST(k AS VARCHAR) AS business_key, NULL AS field, NULL AS expected, NULL AS actual FROM sn WHERE k NOT IN (SELECT k FROM tn)
    UNION ALL SELECT 'ORDER_TARGET_EXTRA', CAST(k AS VARCHAR), NULL, NULL, NULL FROM tn WHERE k NOT IN (SELECT k FROM sn)
    UNION ALL SELECT 'SOURCE_BUSINESS_KEY_DUPLICATE', CAST(k AS VARCHAR), NULL, NULL, NULL FROM sn WHERE n > 1
    UNION ALL SELECT 'ORDER_TARGET_DUPLICATE', CAST(tn.k AS VARCHAR), NULL, NULL, NULL FROM tn JOIN sn USING (k) WHERE tn.n > 1
    UNION ALL SELECT 'ORDER_FIELD_MISMATCH', CAST(os.k AS VARCHAR), 'price', CAST(os.price AS VARCHAR), CAST(ot.price AS VARCHAR) FROM os JOIN ot USING (k) JOIN tn USING (k) WHERE tn.n = 1 AND os.price <> ot.price""")
def reconcile_digest(spark, sf_dir):
    """The same differences as ``reconcile`` of both tables, from the buckets that differ."""
    found = digest_tree.reconcile_by_digest(*_sparse(spark, sf_dir), ["k"], ORDER_RULES)
    return found.diffs.select("diff_type", "business_key", "field", "expected", "actual")


@query(f"""WITH {_SPARSE}, depth AS (SELECT CAST(greatest(1, ceil(ln(count(*) / 16.0) / ln(16))) AS INT) AS d FROM ot),
    rows AS (SELECT 'source' AS side, os.* FROM os UNION ALL SELECT 'target', ot.* FROM ot), placed AS (SELECT rows.*, substr(md5(CAST(k AS VARCHAR)), 1, d) AS node FROM rows, depth),
    per AS (SELECT node, k, status, price, priority, count(*) FILTER (side = 'source') AS a, count(*) FILTER (side = 'target') AS b FROM placed GROUP BY ALL),
    twice AS (SELECT node FROM placed GROUP BY node, side, k HAVING count(*) > 1), wrong AS (SELECT node FROM per WHERE a <> b UNION SELECT node FROM twice)
    SELECT side, count(*) AS n_rows FROM placed WHERE node IN (SELECT node FROM wrong) GROUP BY side""")
def digest_second_pass(spark, sf_dir):
    """Rows of each side that the second pass reads."""
    return digest_tree.reconcile_by_digest(*_sparse(spark, sf_dir), ["k"], ORDER_RULES).read_again()


# ---- keys ---------------------------------------------------------------------------------------------

_KEY_TABLES = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"], "events": ["event_id", "user_id", "event_type", "ts"]}


def _all_keys() -> str:
    """Every combination of up to three columns, counted; of those that are keys the ones that hold no other."""
    tested = [f"SELECT '{t}' AS table_name, '{','.join(c)}' AS key, {n} AS n_columns, (SELECT count(*) = (SELECT count(*) FROM {t}) FROM (SELECT DISTINCT {', '.join(c)} FROM {t})) AS ok" for t, cols in _KEY_TABLES.items() for n in (1, 2, 3) for c in combinations(cols, n)]
    return f"WITH c AS ({' UNION ALL '.join(tested)}), k AS (SELECT * FROM c WHERE ok) SELECT table_name, key, n_columns FROM k WHERE NOT EXISTS (SELECT 1 FROM k s WHERE s.table_name = k.table_name AND s.key <> k.key AND list_has_all(string_split(k.key, ','), string_split(s.key, ',')))"


@query(_all_keys())
def find_keys(spark, sf_dir):
    """The minimal keys of three tables, found and not given."""
    found = [keys.find_keys(table(spark, sf_dir, t), cols).select(F.lit(t).alias("table_name"), "key", "n_columns") for t, cols in _KEY_TABLES.items()]
    return found[0].union(found[1]).union(found[2])


# ---- causes -------------------------------------------------------------------------------------------

_CAUSE_RULES = [FieldRule("status"), FieldRule("price", kind="decimal", scale=2), FieldRule("made", kind="datetime"), FieldRule("priority")]


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders), c AS (SELECT count(*) FILTER (k % 4 = 0) AS scaled, count(*) FILTER (k % 5 = 0) AS late FROM o),
    m AS (SELECT status, count(*) AS n FROM o GROUP BY 1), t AS (SELECT sum(n) AS n FROM m WHERE status IN ('O', 'F'))
    SELECT 'status' AS field, 'value_map' AS cause, status || '=>' || CASE status WHEN 'O' THEN 'open' ELSE 'closed' END AS detail, m.n AS support, round(m.n / t.n, 4) AS share, 1.0 AS confidence FROM m, t WHERE status IN ('O', 'F')
    UNION ALL SELECT 'price', 'unit_scale', '100', scaled, 1.0, 1.0 FROM c UNION ALL SELECT 'made', 'time_zone', '+08:00', late, 1.0, 1.0 FROM c""")
def systematic_causes(spark, sf_dir):
    """A value map, a factor of 100 and eight hours are planted; a few other differences of the priority have no common cause."""
    k = F.col("k")
    made = F.date_format(F.col("odate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    base = orders(spark, sf_dir).select("k", "status", "price", made.alias("made"), F.concat("priority", k % 9).alias("priority"))
    later = F.date_format(F.col("made").cast("timestamp") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss")
    copy = base.select("k", F.when(F.col("status") == "O", "open").when(F.col("status") == "F", "closed").otherwise(F.col("status")).alias("status"), F.when(k % 4 == 0, F.col("price") * 100).otherwise(F.col("price")).cast("decimal(18,2)").alias("price"), F.when(k % 5 == 0, later).otherwise(F.col("made")).alias("made"), F.when(k % 101 == 0, F.concat(F.lit("x"), "k")).otherwise(F.col("priority")).alias("priority"))
    found = causes.systematic_causes(causes.cells(reconcile.matched_rows(base, copy, ["k"], _CAUSE_RULES), _CAUSE_RULES))
    # The price of a few orders may have one value only, which then looks like a map as well.
    return found.where("cause <> 'value_map' or field = 'status'").withColumn("share", F.col("share").cast("double")).withColumn("confidence", F.col("confidence").cast("double"))


# ---- profiles -----------------------------------------------------------------------------------------

_FIELDS = ("status", "priority", "cust", "day")


@query("""WITH f AS (SELECT unnest(['status', 'priority', 'cust', 'day']) AS field, unnest([o_orderstatus, CASE WHEN o_orderkey % 5 < 3 THEN 'std' WHEN o_orderkey % 5 = 3 THEN '' END, CAST(o_custkey % 3 AS VARCHAR), CAST(o_orderkey % 40 AS VARCHAR)]) AS v FROM orders),
    n AS (SELECT field, count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v = '') AS n_empty, count(*) FILTER (v = '0') AS n_zero, count(DISTINCT v) AS n_distinct FROM f GROUP BY field),
    c AS (SELECT field, v, count(*) AS m FROM f WHERE v IS NOT NULL AND v <> '' AND v <> '0' GROUP BY 1, 2), b AS (SELECT field, v, m FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY m DESC, v) = 1)
    SELECT field, n_rows, n_null, n_empty, n_zero, n_distinct, CASE WHEN m >= 0.3 * n_rows THEN v END AS default_value, CASE WHEN m >= 0.3 * n_rows THEN m ELSE 0 END AS n_default, CASE WHEN n_null + n_empty + n_zero + CASE WHEN m >= 0.3 * n_rows THEN m ELSE 0 END = n_rows THEN 'mixed' ELSE 'business' END AS label FROM n JOIN b USING (field)""")
def merged_profiles(spark, sf_dir):
    """The orders in three batches of unequal size, each profiled by itself; the profile of all comes from the three states."""
    k = F.col("k")
    rows = orders(spark, sf_dir).select("k", "status", F.when(k % 5 < 3, "std").when(k % 5 == 3, "").alias("priority"), (F.col("cust") % 3).alias("cust"), (k % 40).alias("day"))
    states = [profiles.profile_state(rows.where(w), [*_FIELDS]) for w in ("k % 7 = 0", "k % 7 in (1, 2)", "k % 7 > 2")]
    return profiles.merge_profiles(profiles.union_states(*states)).drop("top")


# ---- lookups by key and writes that may be repeated ----------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 BETWEEN 100 AND 350 AND o_custkey % 3 <> 0) GROUP BY 1, 2")
def rows_of_keys(spark, sf_dir):
    """Lines of some ranges of orders; at this size the keys become ranges that the scan applies."""
    wanted = orders(spark, sf_dir).where("k % 1000 between 100 and 350 and cust % 3 <> 0").select("k")
    found = lookup.rows_of_keys(table(spark, sf_dir, "lineitem"), wanted, "l_orderkey", max_keys=50)
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'first' ELSE 'second' END AS run_id FROM orders WHERE o_orderkey % 3 < 2")
def repeated_runs(spark, sf_dir):
    """Two runs of a load, the second tried twice and at first with wrong rows; each row stands there once."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = orders(spark, sf_dir).select("k", "status")
    runs.commit_run(rows.where("k % 3 = 0"), path, "first")
    runs.commit_run(rows.where("k % 3 = 1").withColumn("status", F.lit("?")), path, "second")
    runs.commit_run(rows.where("k % 3 = 1"), path, "second")
    return runs.read_runs(spark, path, rows.schema)


# ---- catalogues made of table rows: each part is a column of a table ------------------------------------

_PART_NAMES = ("order_no", "sku_id", "made_at", "note", "line_no")


def _part_catalog(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    name = F.element_at(F.array(*[F.lit(n) for n in _PART_NAMES]), (size % 5 + 1).cast("int"))
    kind = F.when(size % 3 == 0, "varchar").when(size % 3 == 1, "double").otherwise("bigint")
    return p.select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("table_name"), name.alias("column_name"), kind.alias("data_type"), (size % 7 == 0).alias("is_primary"), F.when(size % 11 == 0, "CURRENT_TIMESTAMP").when(size % 13 == 0, "0").alias("column_default"), (size % 2 == 0).alias("is_nullable"), F.col("p_partkey").alias("ordinal_position"))


_PART_CATALOG = f"c AS (SELECT p_partkey, p_type || '/' || p_brand AS table_name, {list(_PART_NAMES)!r}[p_size % 5 + 1] AS column_name, p_size AS s FROM part)"


@query(f"WITH {_PART_CATALOG} SELECT p_partkey, 'full' AS mode FROM c WHERE s % 11 <> 0 AND s % 7 <> 0 UNION ALL SELECT p_partkey, 'minimal' FROM c WHERE (s % 11 <> 0 AND s % 7 <> 0 AND s % 2 <> 0 AND s % 13 <> 0) UNION ALL SELECT p_partkey, 'custom' FROM c WHERE column_name = 'note'")
def insert_columns_of_rows(spark, sf_dir):
    c = _part_catalog(spark, sf_dir)
    pick = lambda mode, named=(): datagen.insert_columns(c, mode, list(named)).select("p_partkey", F.lit(mode).alias("mode"))
    return pick("full").union(pick("minimal")).union(pick("custom", ["note"]))


@query(f"WITH {_PART_CATALOG} SELECT p_partkey, CASE s % 3 WHEN 0 THEN substr('TEST_' || upper(column_name) || '_' || (p_partkey + 1), 1, 10) WHEN 1 THEN (p_partkey + 1) || '.00' ELSE CAST(p_partkey + 1 AS VARCHAR) END AS value FROM c")
def fallback_value_of_rows(spark, sf_dir):
    c = _part_catalog(spark, sf_dir)
    return c.select("p_partkey", datagen.fallback_value(F.col("data_type"), F.col("column_name"), F.col("p_partkey"), F.lit(10)).alias("value"))


def _part_mappings(spark, sf_dir):
    """A scored mapping for each part, as ``best_candidates`` gives them."""
    score = (F.col("p_partkey") % 100 / 100).cast("double")
    best = _part_catalog(spark, sf_dir).withColumns({"json_path": F.concat(F.lit("$."), F.col("p_partkey") % 400), "field_type": F.lit("string"), "numeric_scale": F.when(F.col("p_partkey") % 4 == 0, 5), "required": F.col("p_partkey") % 6 == 0, "score": score})
    return best.withColumn("is_nullable", F.when(F.col("is_nullable"), "YES").otherwise("NO")).withColumn("confidence", schema_match.confidence(F.col("score")))


@query(f"WITH {_PART_CATALOG} SELECT '$.' || (p_partkey % 400) AS json_path, column_name, CASE s % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'decimal' ELSE 'int' END AS kind, CASE WHEN s % 3 = 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE 2 END END AS scale, p_partkey % 6 = 0 OR s % 2 <> 0 AS required, CASE WHEN p_partkey % 100 >= 75 THEN 'high' ELSE 'review' END AS confidence FROM c WHERE p_partkey % 100 >= 55")
def draft_mappings_of_rows(spark, sf_dir):
    return schema_match.draft_mappings(_part_mappings(spark, sf_dir)).select("json_path", "column_name", "kind", "scale", "required", "confidence")


@query(f"WITH {_PART_CATALOG}, r AS (SELECT table_name, column_name, list_position(['line_no', 'order_no', 'sku_id'], column_name) AS rank FROM c WHERE p_partkey % 100 >= 55) SELECT table_name, min_by(column_name, rank) AS column_name FROM r WHERE rank > 0 GROUP BY 1")
def infer_keys_of_rows(spark, sf_dir):
    drafted = schema_match.draft_mappings(_part_mappings(spark, sf_dir))
    return schema_match.infer_keys(drafted, ("line_no", "order_no", "sku_id"), None).select("table_name", "column_name")


@query("SELECT 'c' || p_partkey AS what FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT '$.' || f FROM (SELECT DISTINCT p_partkey % 500 AS f FROM part) WHERE f NOT IN (SELECT p_partkey % 400 FROM part WHERE p_partkey % 100 <> 0)")
def unmatched_of_rows(spark, sf_dir):
    best = _part_mappings(spark, sf_dir).withColumn("column_name", F.concat(F.lit("c"), "p_partkey"))
    fields = table(spark, sf_dir, "part").select(F.concat(F.lit("$."), F.col("p_partkey") % 500).alias("json_path")).distinct()
    columns, left = schema_match.unmatched(best, fields)
    return columns.select(F.col("column_name").alias("what")).union(left.select("json_path"))


# ---- scans and gates over rows that break them ----------------------------------------------------------

@query(r"SELECT doc_id, f AS finding FROM (SELECT doc_id, unnest(['question marks', 'replacement character', 'unicode escape']) AS f, unnest([doc_id % 5 = 0 OR regexp_matches(coalesce(text, ''), '\?{4,}'), doc_id % 7 = 0 OR contains(coalesce(text, ''), chr(65533)), doc_id % 11 = 0 OR regexp_matches(coalesce(text, ''), '\\u[0-9a-fA-F]{4}')]) AS hit FROM documents) WHERE hit")
def scan_garbled_planted(spark, sf_dir):
    """The documents with marks of garbled text planted in some."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k % 5 == 0, " ????? ").otherwise(" "), F.when(k % 7 == 0, "\ufffd").otherwise(" "), F.when(k % 11 == 0, r"\u4e2d").otherwise(" "))
    return redact.scan_garbled(d.select("doc_id", text.alias("text")), "text", ["doc_id"])


@query("""WITH r AS (SELECT p_partkey AS i, p_size AS s FROM part) SELECT CAST(i AS VARCHAR) AS interface_name, p AS problem FROM (SELECT i, unnest(['pass_without_rules', 'pass_without_accuracy', 'blocked_without_evidence', 'differences_without_sample']) AS p,
    unnest([s % 3 = 0 AND s % 4 <> 0, s % 3 = 0 AND s % 5 <> 0, s % 3 = 1 AND s % 2 = 0, s % 7 = 0 AND s % 6 <> 0]) AS hit FROM r) WHERE hit""")
def check_evidence_planted(spark, sf_dir):
    """A result for each part; rules, accuracy, evidence and samples are missing by rule."""
    p, s = table(spark, sf_dir, "part").withColumn("interface_name", F.col("p_partkey").cast("string")), F.col("p_size")
    results = p.select("interface_name", F.when(s % 3 == 0, "PASS").when(s % 3 == 1, "BLOCKED").otherwise("FAIL").alias("status"), F.when(s % 2 == 0, " ").otherwise("log").alias("evidence"), F.when(s % 7 == 0, 3).otherwise(0).alias("n_differences"))
    samples = p.where("p_size % 2 = 0").select("interface_name", F.when(s % 6 == 0, "seen").otherwise(" ").alias("difference_note"))
    return gates.check_evidence(results, p.where("p_size % 4 = 0"), p.where("p_size % 5 = 0"), samples)


@query(r"SELECT page_id, regexp_replace(url, '^([a-z]+://[^/]+).*$', '\1') || '/top/x' AS up, regexp_replace(url, '^([a-z]+://[^/]+).*$', '\1') || '/a/c?q=../b' AS down FROM pages")
def resolve_long_links(spark, sf_dir):
    """Twelve steps up end at the top; a query string is left as it is."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.posexplode(F.array(F.lit("../" * 12 + "top/./x#f"), F.lit("../" * 12 + "a/b/../c?q=../b"))).alias("node_id", "href"))
    out = pages.resolve_links(links, p)
    return out.groupBy("page_id").agg(F.max(F.when(F.col("node_id") == 0, F.col("target_url"))).alias("up"), F.max(F.when(F.col("node_id") == 1, F.col("target_url"))).alias("down"))


# ---- selectors and redaction, another case in each row ---------------------------------------------------

@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS plain, s_suppkey % 2 AS big, s_suppkey % 5 = 0 AS far FROM supplier)
    SELECT k AS page_id, 'class' AS strategy, 'button.btn' AS value, plain = 1 AND big = 0 AND NOT far AS "unique", plain AS n FROM s WHERE plain > 0
    UNION ALL SELECT k, 'class', 'button.big.btn', true, 1 FROM s WHERE big = 1 UNION ALL SELECT k, 'class', 'button.far.btn', true, 1 FROM s WHERE far
    UNION ALL SELECT k, 'scoped', '#box button.btn', plain = 1 AND big = 0, plain FROM s WHERE plain > 0 UNION ALL SELECT k, 'scoped', '#in button.big.btn', true, 1 FROM s WHERE big = 1""")
def locator_classes(spark, sf_dir):
    """Buttons whose classes hold those of others, inside a container, in a nearer one, and outside."""
    k = F.col("s_suppkey")
    html = F.concat(F.lit("<html><body><div id='box'>"), F.repeat(F.lit("<button class='btn'>a</button>"), (k % 3).cast("int")), F.lit("<p id='in'>"), F.when(k % 2 == 1, "<button class='big btn'>b</button>").otherwise(""), F.lit("</p></div>"), F.when(k % 5 == 0, "<button class='far btn'>c</button>").otherwise(""), F.lit("</body></html>"))
    every = locators.page_elements(pages.page_nodes(spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("page_id"), html.alias("html"))))
    found = locators.locator_candidates(every.where("tag = 'button'"), every).where("strategy in ('class', 'scoped')")
    return found.groupBy("page_id", "strategy", "value", "unique").agg(F.count("*").alias("n"))


_FORMS = {"api_key": True, "apiKey": True, "pwd": True, "accessKey": True, "private-key": True, "app_secret": True, "userToken": True, "token_count": False, "credential": True, "keyboard": False, "plain": False}


@query("SELECT event_id, " + ", ".join(f"CASE WHEN list_contains({[n for n, hidden in _FORMS.items() if hidden]!r}, {[*_FORMS]!r}[event_id % {len(_FORMS)} + 1]) THEN '<redacted>' ELSE 'v' || (100000000 + event_id) END AS in_{kind}" for kind in ("map", "json", "text")) + " FROM events")
def redact_forms(spark, sf_dir):
    """A key name in each row, in snake, kebab or camel case, as the key of a map, in JSON and in a text of JSON's form."""
    e = table(spark, sf_dir, "events").withColumn("name", F.element_at(F.array(*[F.lit(n) for n in _FORMS]), (F.col("event_id") % len(_FORMS) + 1).cast("int")))
    value = F.concat(F.lit("v"), F.lit(100000000) + F.col("event_id"))
    doc = F.concat(F.lit('{"'), "name", F.lit('": "'), value, F.lit('"}'))
    hidden = redact.redact_map(F.create_map("name", value))
    return e.select("event_id", F.element_at(hidden, F.col("name")).alias("in_map"), F.regexp_extract(redact.redact_json(doc), r':"([^"]*)"', 1).alias("in_json"), F.regexp_extract(redact.redact_text(doc), r': "([^"]*)"', 1).alias("in_text"))
