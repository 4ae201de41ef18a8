import numpy as np

from concord.llm import vectors
from concord.llm.queries import op9_embeddings


def brute(rows, least=0.93):
    """(id, links, component) of each row, sorted; every row is a vector of its own."""
    ok = [j for j, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for label, dim in {(rows[j][2], len(rows[j][1])) for j in ok}:
        at = [j for j in ok if rows[j][2] == label and len(rows[j][1]) == dim]
        m = np.array([rows[j][1] for j in at], float)
        s = (m @ m.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
        for a, b in zip(*np.nonzero(s >= least)):
            if a != b:
                n[at[a]] += 1
                p, q = find(at[a]), find(at[b])
                root[max(p, q)] = min(p, q)
    low = {}
    for j, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(j)] = min(low.get(find(j), i), i)
    return sorted(((i, n[j], low.get(find(j))) for j, (i, _, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {i: (n, c) for i, n, c in brute(rows)}
    out = {r.vec_id: (r.n_links, r.component_id) for r in op9_embeddings(spark, sf).collect()}
    assert out.keys() == want.keys()
    assert sum(n for n, _ in out.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(out[i][0] <= want[i][0] for i in out)


def test_graph_recall_and_shards(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1500, 24))
    near = base[:200] + 0.05 * rng.normal(size=(200, 24))
    hub = base[0] + 0.05 * rng.normal(size=(300, 24))
    x = np.concatenate([base, near, hub])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows = [(i, v, 0 if 1700 <= i else a) for i, v, a in rows] + [(5000 + i, x[4].tolist(), 0) for i in range(50)]
    rows += [(6000, None, 0), (6001, [0.0] * 24, 0), (6002, [float("nan")] * 24, 0), (6003, [None] * 24, 0), (6004, x[4].tolist(), None), (6005, [], 0), (6006, [1.0, 2.0], 0), (6007, [float("inf")] * 24, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string")
    want = {i: (n, c) for i, n, c in brute(rows)}
    for size in (8192, 300):
        out = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, shard_size=size, block_size=400).collect()}
        assert sum(n for n, _ in out.values()) >= 0.97 * sum(n for n, _ in want.values())
        assert all(out[i][0] <= want[i][0] for i in want)
        assert sum(out[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_rows_count_for_themselves_under_any_label(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.2], [0.3, 0.1, 1.0]
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, b, "x"), (3, b, "x"), (None, c, "x"), (9, c, "x"), (None, c, "y"), (4, a, "é"), (5, a, "é"), (6, a, None), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id int, embedding array<float>, label string, node int, lab int")
    out = vectors.near_duplicates(df)
    assert got(out) == brute([(i, v and np.float32(v).tolist(), x) for i, v, x in rows])
    assert [r.kept for r in out.where("vec_id = 9").collect()] == [True] and out.where("kept is null").count() == 0
