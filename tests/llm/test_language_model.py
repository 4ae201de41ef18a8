import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from concord.llm import language_model as lm
from concord.llm.queries import op8_language_model

SCHEMA = "doc_id long, text string, score int, w string"


def brute(rows, parts=7, held=2):
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % parts == held
    c = Counter()
    for i, t in rows:
        if i is not None and not out(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    return {i: (out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


def check(rows, want):
    for r in rows:
        held, tokens, known, n, base = want[r.doc_id]
        assert (bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n), r
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score <= 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op8_language_model(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, brute(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_awkward_rows_and_small_head(spark):
    rows = [(i, " ".join(["the cat sat", "on the mat"][i % 2] for _ in range(5)) + f" own{i} own{i}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "été " * 60_000), (103, "new new new words"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    for head in (8, 1000):
        out = lm.score(df, head=head, n_classes=12, own=3, buckets=512).collect()
        assert len(out) == len(rows)
        check([r for r in out if r.doc_id is not None], brute(rows))
    assert lm.score(df.limit(0)).count() == 0
    assert all(r.score <= 0 for r in lm.score(df.where("doc_id is null")).collect())


def toy(seed=0, words=40, n_classes=7, own=2, least=0):
    rng = np.random.default_rng(seed)
    names = [lm.END, *(bytes([97 + i % 26, 97 + i // 26, 98]) for i in range(words - 1))]
    c = np.sort(rng.integers(1, 500, words))[::-1].astype(np.int64)
    classes = lm.word_classes(names, c, n_classes, own)
    n = int(classes.max()) + 1
    vocab = lm.Vocabulary({w: i for i, w in enumerate(names)}, classes, np.log10(c + 1.0), *lm.class_trees(c, classes, n, least), n, int(c.sum()) + 30, words + 9, float(-np.log10(30 + 9 + 1)))
    model = lm.Model(vocab, 64)
    model.weights += rng.normal(size=len(model.weights)).astype(np.float32)
    return rng, c, vocab, model


def plain_log(model, code, one, two):
    """The model's probability of a code after two others, by loops."""
    v, n = model.vocab, len(model.vocab.place)
    outcome = lm.REPEAT if code == lm.AGAIN or code >= lm.HEAD and code == one else lm.REST if code == lm.BEYOND else int(v.classes[code - lm.HEAD])
    rows = [int(model.one[one]), int(model.two[two]), 0]
    z = [sum(float(model.top[r, c]) for r in rows) for c in range(v.n_classes)]
    log = z[outcome] - math.log(sum(math.exp(x) for x in z))
    node = code - lm.HEAD
    if outcome > lm.REST:
        log += float(v.share[node])
        node = int(v.leaf[node])
    while outcome > lm.REST and v.parent[node] >= 0:
        up = int(v.parent[node])
        salt = int(model.node[up - n])
        x = float(v.bias[up - n]) + float(model.slots[(int(model.near[one]) ^ salt) & model.mask]) + float(model.slots[(int(model.skip[two]) ^ salt) & model.mask])
        p = 1 / (1 + math.exp(-x))
        log += math.log(p if v.side[node] else 1 - p)
        node = up
    return log / math.log(10) + (v.rest_log if outcome == lm.REST else 0)


def test_token_logs_match_loops():
    rng, _, vocab, model = toy(least=300)
    assert (vocab.leaf >= len(vocab.place)).any()
    none = len(vocab.place) + lm.HEAD
    docs = [rng.integers(0, none, n) for n in (1, 2, 30, 200)] + [np.array([5, 5, 5, 0, 1, 0, 5])]
    codes, starts = np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs[:-1])])
    _, got = model.token_logs(codes, starts)
    want = []
    for d in docs:
        held = [none, none, *d.tolist()]
        want += [plain_log(model, held[i], held[i - 1], held[i - 2]) for i in range(2, len(held))]
    assert np.allclose(got, want, atol=1e-4)


def test_probabilities_of_the_next_word_sum_to_one_in_each_class():
    rng, _, vocab, model = toy(1, least=300)
    n, none = len(vocab.place), len(vocab.place) + lm.HEAD
    for _ in range(6):
        one, two = rng.integers(0, none + 1, 2)
        total = sum(10 ** plain_log(model, w + lm.HEAD, int(one), int(two)) for w in range(n) if w + lm.HEAD != one)
        outcomes = np.exp(model.class_logs(np.arange(vocab.n_classes), np.full(vocab.n_classes, one), np.full(vocab.n_classes, two)))
        assert abs(outcomes.sum() - 1) < 1e-4
        again = 0 if not lm.HEAD <= one < none else 10 ** (plain_log(model, int(one), none, int(two)))
        assert total <= outcomes[2:].sum() + 1e-4 and (again or abs(total - outcomes[2:].sum()) < 1e-4)


def test_without_weights_a_word_has_its_share_of_the_class():
    _, c, vocab, model = toy(2, least=300)
    model.weights[:] = 0
    none = len(vocab.place) + lm.HEAD
    for w in range(len(c)):
        share = c[w] / c[vocab.classes == vocab.classes[w]].sum() / vocab.n_classes
        assert abs(plain_log(model, w + lm.HEAD, none, none) - math.log10(share)) < 1e-4


def test_context_moves_words_inside_their_class():
    rng, c, vocab, model = toy(3)
    model.weights[:] = 0
    pairs = [(w, (w * 7 + 3) % len(c)) for w in range(len(c))]
    codes = np.array([x + lm.HEAD for _ in range(400) for w in rng.permutation(len(c)) for x in pairs[w]], np.int32)
    starts = np.arange(0, len(codes), 2)
    trainer = lm.Trainer(model, 0.1)
    before = model.token_logs(codes, starts)[1].mean()
    for i in range(0, len(codes), 4000):
        trainer.step(codes[i : i + 4000], np.arange(0, min(4000, len(codes) - i), 2))
    inside = [(a, b) for a, b in pairs if (vocab.classes == vocab.classes[b]).sum() > 4 and a != b]
    gain = [plain_log(model, b + lm.HEAD, a + lm.HEAD, len(c) + lm.HEAD) - plain_log(model, b + lm.HEAD, inside[0][0] + lm.HEAD, len(c) + lm.HEAD) for a, b in inside[1:]]
    assert model.token_logs(codes, starts)[1].mean() > before + 0.3 and np.mean(gain) > 0.5


def test_word_counts_equal_split_words_whatever_the_bytes_and_the_flush(spark):
    odd = [bytes([c]) + b" A" + bytes([c]) + b"b\xc3\x89 " + bytes([c]) * 2 for c in range(256)]
    texts = [None, b"", b" ", b"\t\n a \x0b\x0c\r", b"\xff \xfe\xff", b"w " * 70_000, *odd, *(b"own%d all" % i for i in range(700))]
    want = Counter(w for t in texts for w in [*lm.words_of(t), lm.END])
    rows = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary").coalesce(2)
    for flush in (1, 300, 800_000):
        assert {bytes(r.w): r.c for r in lm.word_counts(rows, 1, 2, flush).collect()} == want
    strings = spark.createDataFrame([(1, "É x"), (2, None)], "doc_id long, text string")
    assert {bytes(r.w): r.c for r in lm.word_counts(strings, 1, 2).collect()} == {"É".encode(): 1, b"x": 1, lm.END: 2}
    assert lm.word_counts(rows.limit(0), 1, 2).collect() == []


def test_broadcast_arrays_are_added_to_on_numpys_fast_path():
    rng, c, vocab, model = toy(4)
    sent, weights = pickle.loads(pickle.dumps((vocab, model.weights)))
    got = lm.Model(sent, 64, weights.copy())
    codes, starts = rng.integers(0, len(c) + lm.HEAD, 3000).astype(np.int32), np.arange(0, 3000, 30)
    outcome, one, two = got.contexts(codes, starts)
    inside = np.flatnonzero(outcome > lm.REST)
    kinds = [z.dtype for _, _, _, z, _ in got.climb(sent.leaf.take(codes[inside] - lm.HEAD), one[inside], two[inside])]
    assert kinds and all(k is np.dtype(np.float32) for k in [*kinds, got.slots.dtype, got.top.dtype])
    for m in (model, got):
        lm.Trainer(m, 0.1).step(codes, starts)
    assert (model.weights == got.weights).all() and (got.weights != weights).any()


def test_moves_are_averaged_over_the_tasks_that_made_them():
    moves = [np.array([1, 0, 2], np.float16), np.array([3, 0, 0], np.float16)]
    t = pa.table({"chunk": pa.array([0, 0], pa.int32()), "part": pa.array([16, 17], pa.int32()), "total": pa.array([m.tobytes() for m in moves], pa.binary()), "moved": pa.nulls(2, pa.binary())})
    out = lm._added(pa.concat_tables([lm._added(t), lm._added(t)])).to_pylist()[0]
    assert np.frombuffer(out["total"], np.float32).tolist() == [8, 0, 4] and np.frombuffer(out["moved"], np.uint32).tolist() == [4, 0, 2]


def test_many_tasks(spark):
    df = spark.createDataFrame([(i, f"a b c d{i % 9} " * 20) for i in range(200)], "doc_id long, text string")
    counts = lm.word_counts(df, 7, 2).persist()
    vocab = lm.vocabulary(counts, 1000, 6, 2)
    held = spark.sparkContext.broadcast(vocab)
    coded = lm.encoded(df, held).repartition(40).persist()
    w = lm.train(coded.select("doc_id", "codes"), held, 64, 1, 0.1, least_tokens=300)
    assert np.isfinite(w).all() and np.abs(w).max() > 0.01
