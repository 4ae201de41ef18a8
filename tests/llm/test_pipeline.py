from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from concord.llm import similar_texts, toxicity
from concord.llm.common import materialise

from test_classifiers import plain_toxicity
from test_lines import brute as brute_lines


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(sets[a], sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    by = {}
    for i in range(len(rows)):
        by.setdefault(find(i), set()).add(rows[i][0])
    return sorted(map(sorted, by.values()))


def quick_groups(rows):
    """The same by counting the shingles that two texts share."""
    sets, held, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    blank = None
    for a, own in enumerate(sets):
        both = Counter(b for x in own for b in held.get(x, ()))
        near = [b for b, n in both.items() if n >= 0.8 * (len(own) + len(sets[b]) - n)]
        if not own:
            near, blank = ([] if blank is None else [blank]), a
        for b in near:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        for x in own:
            held.setdefault(x, []).append(a)
    by = {}
    for i in range(len(rows)):
        by.setdefault(find(i), set()).add(rows[i][0])
    return sorted(map(sorted, by.values()))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")) if name == "toxicity" else None
        docs = materialise(stage(spark, docs, sf), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns or name == "mixing"
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert gone == {i for i, t in before.items() if plain_toxicity(model, t) >= 0.7}
            assert sum(labels.get(i) == 1 for i in gone) >= 0.5 * sum(v == 1 for i, v in labels.items() if i in before)
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
        elif name == "line dedup":
            assert {(i, t) for i, t, *_ in brute_lines(list(before.items()), 10)} == set(after.items())
        elif name == "simhash near-dedup":
            assert sorted(after) == [min(g) for g in groups(sorted(before.items()))]
        elif name == "decontamination":
            assert gone == {i for i, t in before.items() if any(x and " ".join(x.split()) in " ".join((t or "").split()) for x in items)}
        else:
            assert all(1 <= r.copies <= 3 for r in docs.collect()) and len(after) > 0.4 * len(before)
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(before)


def test_near_duplicates_at_a_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = quick_groups(rows)
    assert quick_groups(rows[:200]) == groups(rows[:200]) and len(want) < 960
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).collect()) == [min(g) for g in want]


AWKWARD = [(1, None, "s"), (1, "", "s"), (None, "no id here at all", None), (None, "no id here at all", None), (None, "another text without id", "s"), (5, "repeated row of some words", "t"), (5, "repeated row of some words", "t"), (5, "same id and another text", "t"), (6, "long words " * 40_000, "t"), (7, " \n\t ", "s"), (8, "tie one two three", "u"), (9, "tie one two three", "u")]


@pytest.mark.parametrize("order", ["none counted", "common first", "by chance"])
def test_near_duplicates_under_any_order_of_shingles(spark, monkeypatch, order):
    """What ``common_shingles`` counts, in however few texts, sorts the shingles only: no pair is lost by it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = similar_texts.common_shingles

    def other(*args):
        h, n = counted(*args)
        assert len(h)
        return {"none counted": (h[:0], n[:0]), "common first": (h, -n), "by chance": (h[::3], np.random.default_rng(1).integers(-9, 9, len(h[::3])))}[order]

    monkeypatch.setattr(similar_texts, "common_shingles", other)
    want = quick_groups(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert sorted(r.doc_id for r in similar_texts.keep_one(docs).collect()) == [min(g) for g in want]


def test_every_stage_takes_awkward_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, copies int, key string, fp long, h string, m int, u int"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 3, 8, "k", 4, "h", 1, 2) for i, t, s in AWKWARD], schema)
    want = {"toxicity": 12, "line dedup": 12, "simhash near-dedup": 7, "decontamination": 12}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "mixing":
            assert all(1 <= r.copies <= 3 for r in rows) and set(docs.columns) == set(out.columns)
        else:
            assert out.schema.names == docs.schema.names and len(rows) == want[name], (name, len(rows))
            assert {r.n_lines for r in rows} == {3} and {r.copies for r in rows} == {8}
        if name == "line dedup":
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "simhash near-dedup":
            assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted([(1, None), (None, "no id here at all"), (None, "another text without id"), (5, "repeated row of some words"), (5, "same id and another text"), (6, "long words " * 40_000), (8, "tie one two three")], key=str)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_rows_are_kept_by_id_and_text(spark):
    texts = ["alpha beta gamma delta one", "two three four five six", "seven eight nine ten eleven", "red green blue white black", "north south east west up"]
    df = spark.createDataFrame(list(zip([1, 1, 2, None, None], texts)), "doc_id int, text string")
    assert sorted(r.text for r in similar_texts.keep_one(df).collect()) == sorted(texts)
    assert sorted(r.text for r in similar_texts.keep_one(df.union(df)).collect()) == sorted(texts)


def test_similar_texts_awkward_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(5, " ".join(base)), (3, " ".join([*base[:200], "x", *base[201:]])), (4, " ".join(base[:200])), (None, "a b c"), (9, None), (8, ""), (7, " \t"), (6, "é " * 30_000), (6, "é " * 30_000), (10, "É " * 30_000), (2, "A B c"), (5, " ".join(base))]
    df = spark.createDataFrame([(i, t, 1.0, "z") for i, t in rows], "doc_id int, text string, fp double, views string")
    out = similar_texts.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 3), (False, 4), (False, 6), (False, 7), (False, 10), (True, None)]
    assert similar_texts.keep_one(df.limit(0)).count() == 0


def test_similar_texts_alike_only_through_the_base(spark):
    base = [f"w{i}" for i in range(1000)]
    rows = [(1000, " ".join(base))]
    for c in range(150):
        words = list(base)
        for j in range(16):
            words[10 + j * 61 + (c * 7 + j * j) % 53] = f"x{c}.{j}"
        rows.append((c, " ".join(words)))
    assert [len(g) for g in groups(rows)] == [151]
    out = similar_texts.keep_one(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [r.doc_id for r in out.collect()] == [0]


def test_similar_texts_near_the_threshold(spark):
    rows = []
    for c in range(40):
        words = [f"w{c}.{j}" for j in range(1500)]
        edits = 33 if c % 2 else 34
        changed = list(words)
        for j in range(edits):
            changed[20 + j * 40] = "x"
        rows += [(2 * c, " ".join(words)), (2 * c + 1, " ".join(changed))]
    want = [min(g) for g in groups(rows)]
    assert len(want) == 60
    assert sorted(r.doc_id for r in similar_texts.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()) == want
