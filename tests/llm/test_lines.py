import hashlib

import pytest

from concord.llm import lines


def brute(rows, min_docs):
    keys = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    count = {}
    for i, t in rows:
        for k in set(keys(t)):
            count.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x, k in zip(ls, keys(t)) if not (k and len(count[k]) >= min_docs)]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


ROWS = [(i, f" Shared Line\t\nown {i}\n\nÉ x") for i in range(1, 6)] + [(6, None), (7, ""), (8, "shared line"), (9, "É x\né x\nÉ X"), (10, "a\n" * 50_000 + "own 3"), (11, " shared line"), (3, " Shared Line\t\nown 3\n\nÉ x")]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_brute_force_both_ways(spark, most):
    df = spark.createDataFrame([(i, 1, t, "h") for i, t in ROWS], "doc_id long, n_lines int, text string, h string")
    for least in (2, 4):
        out = lines.drop_frequent_lines(df, min_docs=least, max_broadcast=most)
        assert out.columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == brute(ROWS, least)
    assert lines.drop_frequent_lines(df.limit(0), max_broadcast=most).count() == 0


def test_query(spark, sf):
    from concord.llm.queries import op6_line_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows, 10)}
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op6_line_dedup(spark, sf).collect()} == want


def test_rows_without_an_id_are_a_document_apart(spark):
    rows = [(None, "same"), (None, "same"), (-1, "same"), (3, "other\nsame")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int")
    for least, left in ((3, 0), (4, 4)):
        out = lines.drop_frequent_lines(df, min_docs=least, counts=False)
        assert out.columns == df.columns and {r.n_lines for r in out.collect()} == {7}
        assert sum("same" in r.text for r in out.collect()) == left
