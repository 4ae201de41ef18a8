"""Key pushdown and repeatable writes against the database that Spark ships, and against files."""

import uuid

import pytest
from pyspark.sql import functions as F

from concord.operators import schema_match
from concord.sources import lookup, runs, tables


@pytest.fixture(scope="module")
def derby():
    return {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def target(spark, derby):
    spark.range(5000).selectExpr("id * id AS K", "CAST(id % 9 AS STRING) AS V").write.format("jdbc").options(**derby, dbtable="T").save()
    return "T"


def test_few_keys_are_listed(spark, derby, target):
    keys = spark.createDataFrame([(4,), (9,), (9,), (None,), (10,), (4998 * 4998,)], "k long")
    got = lookup.fetch_by_keys(spark, derby, target, keys, "K", batch=2)
    assert sorted(r.K for r in got.collect()) == [4, 9, 4998 * 4998] and got.rdd.getNumPartitions() == 2
    assert lookup.fetch_by_keys(spark, derby, target, keys.limit(0), "K").count() == 0


def test_many_keys_become_ranges_and_rows_follow_them(spark, derby, target):
    ids = [*range(100, 200), *range(3000, 3100)]
    keys = spark.createDataFrame([(i * i,) for i in ids], "k long")
    got = lookup.fetch_by_keys(spark, derby, target, keys, "K", max_keys=50, ranges=40)
    held = [r.K for r in got.collect()]
    assert {i * i for i in ids} <= {*held} and len(held) == len({*held}) < 300
    exact = lookup.rows_of_keys(spark.read.jdbc(derby["url"], target, properties=derby), keys, "K", max_keys=50, ranges=40)
    assert sorted(r.K for r in exact.collect()) == sorted(i * i for i in ids)
    assert lookup.key_predicates(keys.select(F.col("k").cast("string")), "K", max_keys=50) is None


def test_quantiles_share_rows_evenly(spark, derby, target):
    df = lookup.read_by_quantiles(spark, derby, target, "K", 8)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 8 and max(sizes) < 800


def test_a_partitioned_read_of_a_spec(spark, derby, target):
    spec = tables.SourceSpec("jdbc", options={**derby, "dbtable": target, "partitionColumn": "K", "lowerBound": "0", "upperBound": "1000", "numPartitions": "3"}, id_column="K", extra=(("V", "v"),), where="K < 100")
    assert sorted((r.K, r.v) for r in tables.read_source(spark, spec).collect()) == [(i * i, str(i % 9)) for i in range(10)]


def test_files_by_keys(spark, tmp_path):
    spark.range(10_000).selectExpr("id AS k", "id % 7 AS v").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    found = lookup.rows_of_keys(t, spark.range(2000, 2500).selectExpr("id AS x"), "k", max_keys=10)
    assert found.count() == 500 and "GreaterThanOrEqual(k,2000)" in found._jdf.queryExecution().toString()
    assert lookup.rows_of_keys(t, t.select("k").where("k in (3, 5)"), "k").count() == 2


class Died(Exception):
    pass


def dying(df):
    """The same rows, but a task that comes to the last of them dies."""
    return df.withColumn("v", F.when(F.col("k") == 99, F.raise_error(F.lit("task died")).cast("string")).otherwise(F.col("v")))


def test_a_run_of_files_stands_once(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(100).selectExpr("id AS k", "'a' AS v").repartition(4)
    with pytest.raises(Exception, match="task died"):
        runs.commit_run(dying(df), path, "day-1")
    assert runs.read_runs(spark, path, df.schema).count() == 0
    assert runs.commit_run(df, path, "day-1") == 100 and runs.commit_run(df.where("k < 10"), path, "day-2") == 10
    with pytest.raises(Exception, match="task died"):
        runs.commit_run(dying(df), path, "day-1")
    assert runs.commit_run(df.withColumn("v", F.lit("b")), path, "day-1") == 100
    got = runs.read_runs(spark, path, df.schema)
    assert sorted((r.k, r.v, r.run_id) for r in got.collect()) == sorted([(i, "b", "day-1") for i in range(100)] + [(i, "a", "day-2") for i in range(10)])
    assert runs.read_runs(spark, path, df.schema, ["day-2"]).count() == 10
    assert runs.drop_leftovers(spark, path) == 2 and runs.read_runs(spark, path, df.schema).count() == 110
    with pytest.raises(ValueError):
        runs.commit_run(df, path, "../x")


def test_a_run_of_rows_stands_once(spark, derby):
    df = spark.range(100).selectExpr("id AS k", "'a' AS v").repartition(4)
    df.limit(0).withColumn("run_id", F.lit("x")).write.format("jdbc").options(**derby, dbtable="LOADED", createTableColumnTypes="v VARCHAR(20), run_id VARCHAR(200)").save()
    held = lambda: sorted(tuple(r) for r in spark.read.jdbc(derby["url"], "LOADED", properties=derby).collect())
    for attempt in (dying(df), df):
        if attempt is df:
            assert runs.commit_rows(attempt, derby, "LOADED", "r1") == 100
        else:
            with pytest.raises(Exception, match="task died"):
                runs.commit_rows(attempt, derby, "LOADED", "r1")
            assert held() == []
    runs.commit_rows(df.where("k < 5"), derby, "LOADED", "r2")
    with pytest.raises(Exception, match="task died"):
        runs.commit_rows(dying(df), derby, "LOADED", "r1")
    runs.commit_rows(df.withColumn("v", F.lit("b")), derby, "LOADED", "r1")
    assert held() == sorted([(i, "b", "r1") for i in range(100)] + [(i, "a", "r2") for i in range(5)])


def test_candidates_by_postings_hold_the_best_of_all_pairs(spark):
    words = "order number total price of the customer line date ship to id 订单 编号".split()
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 4)) for i in range(1, 60)] + ["", "o", "r 1", "er"]
    columns = spark.createDataFrame([("t", f"c_{i}_{t.split(' ')[0]}", "bigint" if i % 3 else "varchar", t, "YES", i, None) for i, t in enumerate(texts)], "table_name string, column_name string, data_type string, column_comment string, is_nullable string, ordinal_position int, numeric_scale int")
    fields = spark.createDataFrame([(f"$.f{i}", f"f{i}", t[: len(t) - i % 3] if i % 2 else t, "string" if i % 2 else "integer", None, i) for i, t in enumerate(reversed(texts))], "json_path string, name string, comment string, type string, required boolean, field_ordinal int")
    best = lambda n: {(r.column_name, r.json_path, r.score) for r in schema_match.best_candidates(schema_match.score_pairs(columns, fields, only_best=n)).collect()}
    assert best(False) == best(True)
