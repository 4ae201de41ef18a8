import re

from concord.llm import licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for p, label in PHRASES.items():
        q = p.split()
        own = [i for i in range(len(w)) if w[i : i + len(q)] == q]
        places += own
        labels |= {label} if own else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_query(spark, sf):
    from concord.llm.queries import op7_licenses

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    want = {i for i, t in texts.items() if "Released under the MIT License." in t}
    assert want == {r.doc_id for r in rows if "mit" in r.labels.split(",")}


def test_awkward_rows_and_diagonals(spark):
    mit = licenses.TEMPLATES["mit"][0]
    words = mit.split()
    edited = " ".join(words[:20] + ["really"] + words[20:40] + words[41:])
    rows = [(1, None), (2, ""), (3, "CC BY cc-by cc bY"), (4, "cc " * 1000), (5, "cc by " * 30_000), (6, "lead in " + edited + " tail"), (7, " ".join(words[:12])), (8, "é general public license é"), (9, "All rights\nreserved"), (6, "lead in " + edited + " tail")]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id int, text string, score double, labels string")
    out = licenses.scan(df).collect()
    assert len(out) == len(rows)
    check(out, dict(rows))
    by = {r.doc_id: r for r in out}
    assert by[6].labels == "mit" and by[6].spans[0].start == 2 and by[6].score > 0.8
    assert by[7].labels == "" and by[5].n_base == 30_000
    assert licenses.scan(df.limit(0)).count() == 0


def plain_spans(t, k=3, least=0.6, gap=4, near=8):
    """Verified spans of every template by loops over all places."""
    words, out, n = licenses.license_words(t), set(), 0
    for label in sorted(licenses.TEMPLATES):
        for text in licenses.TEMPLATES[label]:
            own = licenses.license_words(text)
            lanes = {}
            for i in range(len(words) - k + 1):
                for j in range(len(own) - k + 1):
                    if words[i : i + k] == own[j : j + k]:
                        lanes.setdefault(i - j, []).append((i, j))
            spans = []
            for d in sorted(lanes, key=lambda d: (d, min(lanes[d]))):
                lo, hi, places = min(i for i, _ in lanes[d]), max(i for i, _ in lanes[d]), {j for _, j in lanes[d]}
                if spans and d - spans[-1][0] <= gap and lo - spans[-1][4] <= near + len(own):
                    last = spans[-1]
                    spans[-1] = (d, min(lo, last[1]), max(hi, last[2]), places | last[3], hi)
                else:
                    spans.append((d, lo, hi, places, hi))
            out |= {(label, lo, hi + k, round(len(p) / (len(own) - k + 1), 9)) for _, lo, hi, p, _ in spans if len(p) / (len(own) - k + 1) >= least}
            n += 1
    return out


def test_votes_match_plain_loops(spark, sf):
    rng = __import__("random").Random(2)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and "icense" in r.text and len(r.text) < 20_000][:15]
    for n, texts in enumerate(licenses.TEMPLATES.values()):
        words = [w for w in " ".join([*texts, "between them", *texts]).split() if rng.random() > 0.06]
        docs += [(1000 + n, "before it " + " ".join(w if rng.random() > 0.05 else "edited" for w in words) + " after"), (None, " ".join(words))]
    out = licenses.scan(spark.createDataFrame(docs, "doc_id int, text string"))
    got = sorted(([r.doc_id, sorted((s.label, s.start, s.end, round(s.coverage, 9)) for s in r.spans)] for r in out.collect()), key=str)
    assert got == sorted(([i, sorted(plain_spans(t))] for i, t in docs), key=str) and sum(len(s) for _, s in got) > 15


def test_large_template_sets_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x " + licenses.TEMPLATES["mit"][0]), (None, "y")], "doc_id int, text string")
    both = []
    for most in (licenses.MAX_BROADCAST, 0):
        monkeypatch.setattr(licenses, "MAX_BROADCAST", most)
        both.append(sorted(licenses.scan(docs).select("doc_id", "labels", "score").collect(), key=str))
    assert both[0] == both[1] and both[0][0].labels == "mit"
