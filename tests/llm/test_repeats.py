import hashlib
import random
from collections import defaultdict

from concord.llm import interleave, repeats
from concord.llm.queries import op12_suffix_dedup


def brute(docs, length):
    """Windows in the order of ids and starts; what an earlier equal one covers goes."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def found(df, length, **how):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(repeats.drop_repeats(df, length, **how)).collect()}


def test_merged_intervals_equal_all_strings():
    rnd = random.Random(1)
    for _ in range(150):
        letters, depth = rnd.choice([b"ab", b"abc", bytes(range(256)), b"\0\1a"]), rnd.choice([1, 2, 3, 5, 9, 17])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 8))]
        texts += texts[: rnd.choice([0, 2])]
        want, got = defaultdict(list), defaultdict(list)
        for i, t in enumerate(texts):
            for p in range(len(t) - depth + 1):
                want[t[p : p + depth]].append((i, p))
        for k, i, p in zip(*(x.tolist() for x in interleave.repeated_intervals(texts, depth, shard_bytes=rnd.choice([1, 20, 1000])))):
            got[k].append((i, p))
        assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_common_prefixes_of_merged_shards():
    texts, depth = [b"banana", b"ananas", b"bandana"], 4
    symbols, starts, _ = interleave.symbols_of(texts)
    shards = [interleave.transform(symbols[a:b], interleave.np.array([0, b - a]), depth) for a, b in zip(starts[:-1], starts[1:])]
    ranks, common = interleave.merge(shards, depth)
    places = interleave.np.concatenate([s.places + a for s, a in zip(shards, starts)])[ranks]
    ends = starts[interleave.np.searchsorted(starts, places, side="right")] - 1
    suffixes = [b"".join(t + b"\0" for t in texts)[p:e] for p, e in zip(places, ends)]
    assert [s[:depth] for s in suffixes] == sorted(s[:depth] for s in suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
        assert n == next((i for i in range(depth) if i >= min(len(a), len(b)) or a[i] != b[i]), depth)


def test_brute_force_with_crowded_anchors(spark):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("ab ") for _ in range(30)) for _ in range(12)]
    docs = [(i, None if i % 17 == 0 else "".join(rnd.choice(pool)[: rnd.randint(5, 30)] for _ in range(rnd.randint(0, 12)))) for i in range(100)]
    docs += [(200 + i, docs[5][1]) for i in range(20)] + [(300, "a" * 5000), (301, "b" + "a" * 3000), (302, "é" * 40), (303, "x" + "é" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {n: brute([(i, (t or "").encode()) for i, t in docs], n) for n in (20, 30)}
    for length, gram, crowd in ((20, 10, 512), (30, 8, 1)):
        assert found(df, length, gram=gram, crowd=crowd, bin_bytes=4000, shard_bytes=900) == want[length]


def test_ids_of_any_kind_and_clashing_names(spark):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([("b", text, 1, "x"), (None, text[:200], 2, "y"), ("b", text, 1, "x"), ("a", None, 3, "z"), ("c", text[150:] + "!", 4, "w")], "doc_id string, text string, key int, runs string")
    got = {(r.doc.doc_id, r.doc.key, r.doc.runs, r.n_bytes, bytes(r.kept)) for r in repeats.drop_repeats(df, 50, gram=20).collect()}
    assert got == {(None, 2, "y", 200, text[:200].encode()), ("b", 1, "x", 300, text[200:].encode()), ("a", 3, "z", 0, b""), ("c", 4, "w", 151, b"!")}
    assert repeats.drop_repeats(df.limit(0), 50, gram=20).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op12_suffix_dedup(spark, sf).collect()}
    assert got == brute(rows, 100) and sum(x[1] for x in got.values()) > 0
