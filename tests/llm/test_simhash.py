import numpy as np
import xxhash

from concord.llm import simhash
from concord.llm.queries import op1_simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute(rows, k=3, radius=2):
    fps = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], dtype=np.uint64)
    lab = list(range(len(ids)))

    def find(a):
        while lab[a] != a:
            a = lab[a]
        return a

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(x[a] ^ x[a + 1 :]) <= radius):
            r, s = find(a), find(a + 1 + int(b))
            lab[max(r, s)] = min(r, s)
    return {i: (f"{fps[i]:016x}", ids[find(a)]) for a, i in enumerate(ids)}


def got(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op1_simhash(spark, sf)) == brute(rows)


def test_awkward_rows(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, " ".join(base)), (7, " ".join([*base[:299], "x"])), (8, "ONE  two"), (9, "a b c " * 50_000), (10, "    é")]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    out = simhash.near_duplicates(df).withColumn("fingerprint", simhash.hex_digits("fp"))
    assert got(out) == brute(rows)
    again = simhash.near_duplicates(df.union(df))
    assert again.count() == 20 and again.select("doc_id", "component_id").distinct().count() == 10
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_take_ball_keys(spark):
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)), rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    a = simhash.components(simhash.links(fps, 2, pairwise=8192)).collect()
    b = simhash.components(simhash.links(fps, 2, pairwise=4)).collect()
    assert set(a) == set(b) and len(a) > 300


def test_thresholds_sum_and_cost():
    cost, picks = simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 0)
    assert (cost, picks) == (7, [0, 1, -1])


def test_rows_without_an_id_take_part(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (4, "A b c d"), (None, "z y x"), (None, ""), (8, None)]
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str)
    assert out == sorted([(None, 4), (5, 4), (4, 4), (None, None), (None, 8), (8, 8)], key=str)


def test_hot_keys_join_like_others(spark):
    from concord.llm.common import join_split

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    side = rows.groupBy("k").count().withColumnRenamed("count", "n")
    for share in (2, 1000, 100_000):
        out = join_split(rows, side.selectExpr("k", "n", "k * 2 as v"), ["k"], "n", share)
        assert out.count() == 5000 and out.where("v <> 2 * k").count() == 0
