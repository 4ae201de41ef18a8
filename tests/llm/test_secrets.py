import hashlib
import re
import time

from concord.llm import secrets

SCHEMA = "doc_id long, text string, source string, spans int"
KINDS = ["assign", "access", "hex"]


def brute(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    n = [sum(x[1] == k for x in out) for k in range(3)]
    return (*n, hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)).encode()).hexdigest())


def check(rows, texts):
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(texts[r.doc_id]), r
        base = [f"{KINDS[k]}" for k in range(3)]
        assert sum(r.spans.count(f"{k}:") for k in base) == r.n_assign + r.n_access + r.n_hex


def owned(rows, max_owners=1, max_repos=3, min_bits=3.0):
    """Span texts of each row by plain counting of owners and repositories."""
    found = [secrets.find(t) for _, t, _ in rows]
    owners, repos = {}, {}
    for j, ((i, _, o), (base, more)) in enumerate(zip(rows, found)):
        for *_, v in base + more:
            owners.setdefault(v, set()).add(o)
            repos.setdefault(v, set()).add((o, ("row", j) if i is None else i))
    out = []
    for (i, _, _), (base, more) in zip(rows, found):
        live = [x for x in more if len(owners[x[3]]) <= max_owners and len(repos[x[3]]) <= max_repos and secrets.entropy(x[3]) >= min_bits]
        spans = sorted((s, secrets.ORDER.index(k), e, k) for k, s, e, _ in base + live)
        out.append((i, ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)))
    return sorted(out, key=str)


def test_query(spark, sf):
    from concord.llm.queries import op10_secrets

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op10_secrets(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, {i: t for i, t, _ in docs})
    assert sorted(((r.doc_id, r.spans) for r in rows), key=str) == owned(docs)


def test_ownership_and_awkward_rows(spark):
    live, example = "Zx9-Qw3rTy7uIoP2aSdF5gHj", "Ab1-Cd2eFg3hIj4kLm5nOp6q"
    rows = [(1, None, "a"), (2, "", None), (3, f"é use {live} now", "a")] + [(10 + i, f"docs say {example}", f"s{i}") for i in range(5)]
    rows += [(20, 'ſecret=abcdefgh SECRET : "abcdefgh" api_key=short APIKEY=12345678 Key', "b"), (21, "AKIA12345678901 AKIA123456789012 " + "0f" * 16 + " " + "0f" * 15, "b"), (22, "x" * 200_000 + " token=" + "a" * 40, "b"), (3, f"é use {live} now", "a"), (None, "password=abcdefgh1", "c")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    out = secrets.digest(secrets.scan(df)).collect()
    assert len(out) == len(rows)
    check(out, {i: t for i, t, _ in rows})
    assert sorted(((r.doc_id, r.spans) for r in out), key=str) == owned(rows)
    by = {r.doc_id: r.spans for r in out}
    assert by[3] == "random:6:30" and all(by[10 + i] == "" for i in range(5))
    assert secrets.scan(df.limit(0)).count() == 0


def test_rows_without_an_id_are_repositories_of_their_own(spark):
    value = "Zx9-Qw3rTy7uIoP2aSdF5gHj"
    for n in (3, 4):
        rows = [(None, f"has {value}", None)] * n + [(5, "nothing", "\0")]
        out = secrets.digest(secrets.scan(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))).collect()
        assert sorted(((r.doc_id, r.spans) for r in out), key=str) == owned(rows)
        assert sum(r.spans != "" for r in out) == (n if n == 3 else 0)


def test_long_values_are_candidates():
    letters, digits = "aBcDe-fGhIj_" * 12, "1234567890-" * 14
    for token in (letters + "7" + letters, digits + "x", "k9" * 100 + "=="):
        assert secrets.find(f"use {token} now")[1] == [("random", 4, 4 + len(token), token)]
    assert secrets.find(f"use {letters} {digits} now")[1] == []
    assert ("url", 108, 188, "p" * 80) in secrets.find("https://" + "u" * 99 + ":" + "p" * 80 + "@host")[1]


def test_many_matches_take_time_in_proportion():
    text = " ".join(f"token=abcdefgh{i} Kx9Qw3rTy7uIoP2aSdF5{i:06d} https://u:secret{i}@h" for i in range(60_000))
    began = time.time()
    base, more = secrets.find(text)
    assert len(base) == 60_000 and len(more) == 120_000 and time.time() - began < 20
    began = time.time()
    secrets.find("eyJabcdefgh" * 30_000)
    assert time.time() - began < 5
