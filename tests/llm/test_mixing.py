import itertools
import random

from concord.llm import mixing


def test_targets():
    assert mixing.fill_targets([10, 100, 100], [1, 2, 3]) == [30.0, 72.0, 108.0]
    assert mixing.fill_targets([0, 5], [1, 1]) == [0.0, 5.0]
    assert mixing.fill_targets([], []) == []


def cost_of(patterns, routed):
    total = 0
    for (_, t), r in zip(patterns, routed):
        f = sum(r.values())
        for level in range(3):
            total += level * min(t, max(0, f - level * t))
    return total


def test_flow_is_largest_and_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        patterns = [(tuple(sorted(rng.sample(range(3), rng.randint(1, 2)))), rng.randint(1, 3)) for _ in range(3)]
        quotas = [rng.randint(0, 6) for _ in range(3)]
        routed = mixing.route(patterns, quotas)
        got = [sum(r.get(m, 0) for r in routed) for m in range(3)]
        assert all(g <= q for g, q in zip(got, quotas))
        best = None
        splits = [[dict(zip(ms, x)) for x in itertools.product(range(10), repeat=len(ms)) if sum(x) <= 3 * t] for ms, t in patterns]
        for pick in itertools.product(*splits):
            use = [sum(r.get(m, 0) for r in pick) for m in range(3)]
            if all(u <= q for u, q in zip(use, quotas)):
                key = (-sum(use), cost_of(patterns, pick))
                best = key if best is None or key < best else best
        assert (-sum(got), cost_of(patterns, routed)) == best


def test_query(spark, sf):
    from concord.llm.queries import op2_mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op2_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mixing(spark, sf).collect()))
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    src = {r.doc_id: r.source for r in docs}
    assert {r.doc_id: r.size for r in rows} == size
    names = sorted(set(src.values()))
    held = [sum(size[d] for d in size if src[d] == n) for n in names]
    target = dict(zip(names, mixing.fill_targets(held, [1 + i % 3 for i in range(len(names))])))
    for n, h in zip(names, held):
        own = [r for r in rows if src[r.doc_id] == n]
        assert all(r.source_size == h and abs(r.target - target[n]) < 1e-6 for r in own)
        taken = sum(r.taken for r in own)
        assert abs(target[n] - taken) < max(0.01 * target[n], 0.25 * max(r.size for r in own)), (n, taken, target[n])
    assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in rows)


def test_overlap_and_awkward_rows(spark):
    rows = [(i, "w " * 10, ["a"], 1.0) for i in range(50)] + [(100 + i, "x y\tz ", ["b", "a", "b"], 2.0) for i in range(50)]
    rows += [(None, None, None, 0.0), (None, "n n", None, 0.0), (7, "w " * 10, ["a"], 1.0), (300, "", [], 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source array<string>, size double")
    chosen, sources = mixing.mix(df, weights=lambda names: [1] * len(names))
    out = chosen.collect()
    assert len(out) == len(rows) and sources.count() == 3
    assert all(0 <= r.copies <= 3 for r in out)
    total = sum(r.size for r in out)
    assert abs(sum(r.size * r.copies for r in out) - total) < 0.2 * total
    none, _ = mixing.mix(df.limit(0))
    assert none.count() == 0


def test_too_many_patterns_raise(spark):
    import pytest

    df = spark.createDataFrame([(i, "a b", [f"s{i}"]) for i in range(5)], "doc_id int, text string, source array<string>")
    with pytest.raises(ValueError, match="max_patterns=4"):
        mixing.mix(df, max_patterns=4)
    assert mixing.mix(df, max_patterns=5)[0].count() == 5


def test_rows_carry_their_own_copies(spark):
    rows = [(7, f"word {'w ' * n}", s) for n in range(1, 40) for s in ("a", "b", None)] + [(None, "x " * n, "b") for n in range(1, 9)] + [(1, None, "a"), (1, "", "c"), (2, "long " * 50_000, "b")]
    df = spark.createDataFrame([(i, t, s, 99, "p") for i, t, s in rows], "doc_id int, text string, source string, copies int, p string")
    chosen = {(r.doc_id, r.size, r.sources[0]): r.copies for r in mixing.mix(df)[0].collect()}
    taken = mixing.take(df)
    assert taken.columns == ["doc_id", "text", "source", "p", "copies"]
    got = {(r.doc_id, len((r.text or "").split()), r.source): r.copies for r in taken.collect()}
    assert got == {k: c for k, c in chosen.items() if c} and len(set(chosen.values())) > 1
    assert mixing.take(df.limit(0)).count() == 0


def test_very_long_texts_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "w\t" * 300_000, "a"), (2, "a b", "a")], "doc_id int, text string, source string")
    assert sorted(r.size for r in mixing.mix(df)[0].collect()) == [2, 300_000]
