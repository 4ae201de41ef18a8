import pytest

from concord.llm import common, components, lines, similar_texts


def test_settings_stay_as_they_were(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    common.materialise(spark.range(3), "three")
    assert spark.conf.get(setting) == before


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_line_dedup_keeps_columns_of_any_name(spark, most):
    df = spark.createDataFrame([(i, "same line\nown %d" % i, f"t{i}", f"h{i}", f"d{i}") for i in range(12)], "doc_id long, text string, _t string, _hits string, doc string")
    out = lines.drop_frequent_lines(df, max_broadcast=most, counts=False)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == sorted((i, f"own {i}", f"t{i}", f"h{i}", f"d{i}") for i in range(12))


def test_near_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "x1", "y1", "z1"), (2, text, "x2", "y2", "z2"), (2, text, "x2", "y2", "z2")], "doc_id long, text string, _id string, _digest string, doc string")
    out = similar_texts.keep_one(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, text, "x1", "y1", "z1")]


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for call in (lines.drop_frequent_lines, similar_texts.keep_one):
        with pytest.raises(TypeError, match="whole numbers"):
            call(df)


def test_rounds_of_components_read_the_edges_twice_at_most(spark):
    edges = common.materialise(spark.createDataFrame([(b, a) for a, b in zip(range(9), range(1, 10))], "u long, v long"), "edges")
    for half in (components._large_star, components._small_star):
        assert half(edges)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 10)} | {(0, 0)}
