import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from concord.llm import variants
from concord.llm.queries import op13_variants


def brute(rows, min_chars, min_n, drop_every, factor):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % drop_every == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_n}
    masks, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in counts:
                near[w].add(x)
                near[x].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form, out = {w: b for w, b in best.items() if counts[b] >= factor * counts[w]}, []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_edits_of_one():
    for a, b, want in (("abc", "abd", 1), ("abc", "ab", 1), ("abc", "bc", 1), ("abc", "abc", 0), ("abc", "acb", 0), ("ab", "ba", 0), ("a", "", 1), ("abxc", "abc", 1), ("abcd", "ab", 0)):
        assert variants.near(a, b) == variants.near(b, a) == bool(want)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(60)] + ["a" * n for n in (39, 40, 41, 42)] + ["a" * 40 + "b", "b" + "a" * 41, "日本", "日x本"]
    left, right = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    assert variants.Letters(words).near(left, right).tolist() == [variants.near(words[i], words[j]) for i, j in zip(left, right)]


def test_brute_force(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcé×") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    rows = [(i or None, " ".join(rnd.choice(words[: rnd.randint(1, 60)]).upper() for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "1", "ß", "Āx"])) for i in range(120)] + [(999, None), (1000, ""), (7, "abc " * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(3)
    for min_chars, min_n, every, factor, shard in ((3, 2, 7, 2, 1000), (2, 1, 3, 5, 1)):
        got = variants.group(variants.word_counts(df, min_chars, min_n, every), factor, shard)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_chars, min_n, every, factor)
    assert variants.group(variants.word_counts(df.limit(0))).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op13_variants(spark, sf).collect()) == brute(rows, 6, 5, 199, 5)
