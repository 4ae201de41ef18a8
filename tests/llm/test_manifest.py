import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from concord.llm import manifest
from concord.llm.queries import op11_manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h([field(x) for x in r[:4]] + [field(text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    """Trees by plain lists, proofs by walking up; rows are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for v in by.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {k: levels([leaf(r, r[4]) for r in v]) for k, v in by.items()}
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    top, out = levels([trees[k][-1][0] for k in order]), []
    for k, v in by.items():
        for i, r in enumerate(v):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now, met = leaf(r, text), []
            for tree, at in ((trees[k], i), (top, order.index(k))):
                for level in tree[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    met += run[: at % 3] + run[at % 3 + 1 :]
                    now, at = h(run[: at % 3] + [now] + run[at % 3 + 1 :]), at // 3
            out.append((r[0], leaf(r, r[4]), trees[k][-1][0], top[-1][0], h(met), now, now == top[-1][0]))
    return sorted(out, key=str)


def whole(docs, height):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    built = manifest.build(docs, manifest.leaf([*fields, F.col("text")]), {"cut": manifest.leaf([*fields, cut])}, height=height)
    return sorted((tuple(r) for r in manifest.digest(manifest.prove(built, "cut")).collect()), key=str)


def test_trees_of_any_size(spark):
    rnd = random.Random(2)
    for n, sources, height in ((1, [None], 5), (30, ["a", None, "", "b", "é", "Z"], 1), (700, ["a", "b", None], 2), (90, [str(i) for i in range(80)], 2)):
        rows = [(i if rnd.random() > 0.05 else None, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([1, None]), rnd.choice([None, "", "a\nb", "ü\n" * i])) for i in range(n)]
        rows += rows[:3]
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
        assert whole(docs, height) == brute(rows)
    assert whole(docs.limit(0), 5) == []


def test_layout_places_every_node_once():
    for n in range(1, 8):
        seen = np.concatenate([manifest.address(n, d, np.arange(3**d)) for d in range(n)])
        assert sorted(seen.tolist()) == list(range(manifest.size(n)))
    # The upper half of the levels comes first, then each lower subtree in one piece.
    assert manifest.address(4, 1, np.arange(3)).max() < manifest.size(2)
    inner = np.concatenate([manifest.address(4, 2, np.arange(1)), manifest.address(4, 3, np.arange(3))])
    assert sorted(inner.tolist()) == list(range(manifest.size(2), 2 * manifest.size(2)))


def test_query(spark, sf):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op11_manifest(spark, sf).collect()), key=str) == brute(rows)
