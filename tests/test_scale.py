"""How work is dealt out: what Spark would broadcast by a wrong estimate, and small tables of much work."""

from pyspark.sql import functions as F

from concord.operators import locators, pages, reconcile, schema_match
from concord.plans import data_queries, result_queries


def test_nodes_are_measured_before_they_are_joined(spark):
    """Few bytes of pages make many nodes: they are not broadcast by the size of the pages."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20kb")
    try:
        html = F.concat(F.lit("<div class='modal'><h4>T</h4>"), F.repeat(F.lit("<button>a longer text of a button</button>"), 40), F.lit("</div>"))
        df = pages.page_interactions(pages.page_nodes(spark.range(200).select(F.col("id").alias("page_id"), html.alias("html"))))
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 200 and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_elements_are_not_broadcast_where_other_plans_need_more_shuffles(spark):
    """Joins by page and node need a shuffle more than a broadcast by the size of the pages does, so a broadcast in the first plan would stay, however large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20kb")
    try:
        html = F.concat(F.lit("<div id='box'>"), F.repeat(F.lit("<button class='main'>a longer text of a button</button>"), 40), F.lit("</div>"))
        every = locators.page_elements(pages.page_nodes(spark.range(200).select(F.col("id").alias("page_id"), html.alias("html"))))
        e = locators.business_elements(every)
        found = locators.locator_candidates(e, every).where("strategy = 'xpath'").join(e.select("page_id", "node_id", "business_type"), ["page_id", "node_id"])
        first = found._jdf.queryExecution().executedPlan().toString()
        df = e.join(every.select("page_id", "node_id", "xpath"), ["page_id", "node_id"])
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == 8000 and "BroadcastHashJoin" not in plan.split("Initial Plan")[0] and "BroadcastHashJoin" not in first


def test_pages_of_a_small_table_are_parsed_in_many_tasks(spark, sf):
    assert result_queries._forms(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def _catalogues(spark, n: int):
    words, names = ("red", "ring", "big", "order"), ("order no", "colour", "ring size", "zz")
    word = lambda c, k: F.get(F.array(*[F.lit(w) for w in words]), (c / k % 4).cast("int"))
    i = F.col("id")
    text = F.when(i % 7 != 0, F.concat_ws(" ", word(i, 1), word(i, 3)))
    name = lambda p: F.concat(F.get(F.array(*[F.lit(x) for x in names]), (i / 5 % 4).cast("int")), F.lit(f" {p}"), F.translate(i.cast("string"), "0123456789", "abcdefghij"))
    columns = spark.range(n).select(F.lit("t").alias("table_name"), name("c").alias("column_name"), F.when(i % 2 == 0, "varchar").otherwise("int").alias("data_type"), text.alias("column_comment"), F.lit("YES").alias("is_nullable"), i.alias("ordinal_position"), F.lit(None).cast("int").alias("numeric_scale"))
    fields = spark.range(1, n).select(F.concat(F.lit("$."), i).alias("json_path"), name("f").alias("name"), text.alias("comment"), F.when(i % 3 == 0, "string").when(i % 3 == 1, "int").alias("type"), F.lit(None).cast("boolean").alias("required"), (n - i).alias("field_ordinal"))
    return columns, fields


def test_best_fields_by_classes_of_comments_equal_all_pairs(spark):
    columns, fields = _catalogues(spark, 90)
    best = lambda only: sorted((r.column_name, r.json_path, r.score) for r in schema_match.best_candidates(schema_match.score_pairs(columns, fields, only_best=only)).collect())
    assert best(True) == best(False)


def test_columns_of_one_comment_do_not_meet_all_fields_of_it(spark):
    columns, fields = _catalogues(spark, 300)
    columns, fields = columns.withColumn("column_name", F.concat(F.lit("c"), F.translate(F.col("ordinal_position").cast("string"), "0123456789", "abcdefghij"))), fields.withColumn("name", F.concat(F.lit("f"), F.translate("name", " ", "")))
    assert schema_match.score_pairs(columns, fields, only_best=True).count() <= 2 * 300


def test_rows_of_much_work_are_dealt_over_many_tasks(spark, sf):
    n = 4 * spark.sparkContext.defaultParallelism
    assert result_queries._part_columns(spark, sf).rdd.getNumPartitions() == n
    assert data_queries.redact_keys(spark, sf).rdd.getNumPartitions() == n


def test_candidate_keys_are_counted_without_copies_of_the_rows(spark):
    df = spark.range(60).selectExpr("id % 7 AS a", "IF(id % 5 = 0, NULL, id % 5) AS b", "id % 3 AS c", "id")
    candidates = [["a"], ["a", "b"], ["c"], ["c", "b", "a"], ["id"]]
    found = reconcile.key_uniqueness(df, candidates)
    table = df.collect()
    assert {r.candidate: (r.n_rows, r.n_distinct, r.is_unique) for r in found.collect()} == {",".join(c): (60, n, n == 60) for c in candidates for n in [len({tuple(r[x] for x in c) for r in table})]}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n_rows, r.n_distinct) for r in reconcile.key_uniqueness(df.limit(0), candidates).collect()} == {(0, 0)}
