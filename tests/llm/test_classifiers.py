import math
import re
import zlib

import numpy as np
import pytest
import zstandard

from concord.llm import quality, toxicity
from concord.llm.queries import op4_toxicity, op5_quality


def auc(pairs):
    pos, neg = ([s for s, y in pairs if y == k] for k in (1, 0))
    pos, neg = np.sort(pos), np.sort(neg)
    return (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / (len(pos) * len(neg))


@pytest.mark.parametrize("query, label, parts, held", [(op4_toxicity, "toxic", 3, 1), (op5_quality, "quality", 4, 2)])
def test_held_out(spark, query, label, parts, held):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    out = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert auc(out) > 0.9, auc(out)


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "... !!!"), (5, "bad. " * 60_000), (None, "fine words here"), (6, "é"), (6, "é")]


def test_awkward_rows(spark):
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t in AWKWARD], "doc_id int, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, i % 2, i % 2, 0) for i in range(1, 7)] + [(None, 1, 1, 0), (1, None, None, 0), (5, 0, 0, 0)], "doc_id int, toxic int, quality int, text int")
    for fit, score in ((toxicity.fit, toxicity.score), (quality.fit, quality.score)):
        for own in (labels, labels.limit(0)):
            out = score(df, fit(df, own)).collect()
            assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
            assert len({r.score for r in out if r.doc_id == 6}) == 1
        assert score(df.limit(0), fit(df.limit(0), labels)).count() == 0
    kept = toxicity.drop_toxic(df, toxicity.fit(df, labels.limit(0)))
    assert kept.columns == df.columns and kept.count() == len(AWKWARD) and toxicity.drop_toxic(df.limit(0), toxicity.ToxicityModel({}, -7.0)).count() == 0


def test_offending_sentences_are_located(spark):
    texts = [(i, ("Good day to you. " * (i % 5)) + ("You are scum here. " if i % 3 == 0 else "You are kind here. ") + "Bye now.") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in out)
    assert {s.text for r in out for s in r.sentences} == {"You are scum here"}
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {i for i in range(300) if i % 3}


def plain_toxicity(model, text):
    best, low = {}, 0.0
    for sentence in re.split(r"[.!?\n]", (text or "").encode().lower().decode()):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", sentence)
        hits = {f for w in words for f in (w.encode(), *(b"^" + w.encode()[:n] for n in (4, 5, 6) if len(w.encode()) >= n)) if f in model.weights}
        if hits:
            best[frozenset(hits)] = 1 / (1 + math.exp(-model.bias - sum(model.weights[f] for f in hits)))
        elif words:
            low += 1 / (1 + math.exp(-model.bias))
    low += sum(p for p in best.values() if p < toxicity.FLOOR)
    rest = toxicity.FLOOR * (1 - math.exp(-low / toxicity.FLOOR))
    return 1 - (1 - rest) * math.prod(1 - p for p in best.values() if p >= toxicity.FLOOR)


def plain_quality(model, text):
    data, size = (text or "").encode(), 0
    for at in range(0, len(data), model.block):
        for sign, d in ((1, model.bad), (-1, model.good)):
            z = zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d))
            size += sign * len(z.compress(data[at : at + model.block]))
    return 1 / (1 + math.exp(-model.slope * (size / len(data) if data else 0) - model.offset))


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, toxicity.fit(docs, labels), quality.fit(docs, labels)


def test_scores_match_plain_loops(fitted):
    docs, toxic, good = fitted
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, toxic).collect():
        assert math.isclose(r.score, plain_toxicity(toxic, texts[r.doc_id]), abs_tol=1e-9)
    for r in quality.score(docs, good).collect():
        if r.doc_id % 5 == 0:
            assert math.isclose(r.score, plain_quality(good, texts[r.doc_id]), abs_tol=1e-9)


def test_length_does_not_make_a_text_toxic(spark, fitted):
    docs, model, _ = fitted
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = {i: plain_toxicity(model, t) for i, t in rows}
    clean = [t for i, t in rows if t and scores[i] < toxicity.FLOOR]
    assert len(clean) > 300
    joined = spark.createDataFrame([(0, "The river runs past the old mill and nobody minds. " * 100_000), (1, ". ".join(clean[:300])), (2, (clean[0] + ". ") * 3000)], "doc_id int, text string")
    assert all(r.score <= 2 * toxicity.FLOOR for r in toxicity.score(joined, model).collect())
    assert toxicity.drop_toxic(joined, model).count() == 3


def test_copies_share_one_weight(spark):
    copy = "one text that was copied a lot with the rare word zyzzyva in it"
    rows = [(i, copy) for i in range(90)] + [(100 + i, f"u{i} v{i} w{i} x{i} y{i}") for i in range(10)]
    w = toxicity.copy_weights(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(abs(w[i] - 1 / 90) < 1e-12 for i in range(90)) and all(w[100 + i] == 1 for i in range(10))


def test_too_little_text_for_training_is_its_own_dictionary(spark):
    docs = spark.createDataFrame([(i, "fine calm words" if i % 2 else "junk junk 123") for i in range(40)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id int, quality int")
    model = quality.fit(docs, labels)
    assert b"fine calm words" in model.good and b"junk junk 123" in model.bad
    out = quality.score(docs, model).collect()
    assert min(r.score for r in out if r.doc_id % 2) > max(r.score for r in out if not r.doc_id % 2)
