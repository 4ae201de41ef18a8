import pytest

from concord.llm import decontaminate
from concord.llm.queries import op3_decontamination

ITEM = "Once Tom has 12 apples and gives 5 kg of them to Anna before Tom walks 3 miles home in the rain with nobody else around"
OTHER = "Once Jim has 90 apples and gives 7 kg of them to Beth before Jim walks 4 miles home in the rain with nobody else around"
BROKEN = "Once Jim has 90 apples and gives 7 kg of them to Beth before Bob walks 4 miles home in the rain with nobody else around"


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_slots(spark, most):
    docs = spark.createDataFrame([(1, f"intro words. {OTHER} more"), (2, ITEM.lower()), (3, BROKEN), (4, None), (5, ""), (6, "Tom has 12 apples"), (7, f"x {ITEM} " * 300), (8, "1 2 3 4 5 6 7 8 9 10 " * 20), (1, f"intro words. {OTHER} more"), (None, ITEM)], "doc_id int, text string").selectExpr("*", "1 as item_id", "0 as h")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "only four words here"), (14, "1 2 3 4 5 6")], "item_id int, text string")
    out = decontaminate.find(docs, items, max_broadcast=most).collect()
    got = {(r.doc_id, r.item_id): r for r in out}
    assert got[1, 10].changed and got[1, 10].contaminated and got[1, 10].coverage > 0.9 and sum(r.doc_id == 1 for r in out) == 2
    assert got[7, 10].contaminated and not got[7, 10].changed and got[None, 10].contaminated
    assert got[3, 10].consistency < 1 and (8, 14) in got and not {4, 5, 6} & {d for d, _ in got}
    kept = decontaminate.drop_contaminated(docs, items, max_broadcast=most)
    assert kept.columns == docs.columns and {1, 7} & {r.doc_id for r in kept.collect()} == set()
    assert decontaminate.find(docs.limit(0), items, max_broadcast=most).count() == 0
    assert decontaminate.find(docs, items.limit(0), max_broadcast=most).count() == 0


def test_query_finds_whole_passages_only(spark, sf):
    docs = {r.doc_id: " ".join((r.text or "").split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    out = op3_decontamination(spark, sf).collect()
    got = {(r.doc_id, r.item_id) for r in out if r.contaminated}
    assert whole and whole <= got
    words = lambda t: {tuple(w[j : j + 5]) for w in [[x.lower().strip(".,") for x in t.split()]] for j in range(len(w) - 4)}
    assert all(len(words(docs[d]) & words(items[i])) >= 0.5 * len(words(items[i])) for d, i in got)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_occurrences_do_not_spoil_each_other(spark, most):
    third = "Once Sam has 33 apples and gives 8 kg of them to Cleo before Sam walks 6 miles home in the rain with nobody else around"
    torn = f"{ITEM[:62]} {'some words between them ' * 30} {ITEM[62:]}"
    docs = spark.createDataFrame([(1, f"{ITEM} {OTHER}"), (2, f"Well. {OTHER} and {third}"), (3, f"{BROKEN} {BROKEN}"), (4, torn), (None, f"{OTHER} {third}")], "doc_id int, text string")
    items = spark.createDataFrame([(10, ITEM), (11, OTHER)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs, items, max_broadcast=most).collect()}
    assert all(got[d, i].contaminated for d in (1, 2, None) for i in (10, 11))
    assert not got[1, 10].changed and not got[1, 11].changed and got[2, 10].changed
    assert got[3, 10].consistency < 1
    assert set(decontaminate.drop_contaminated(docs, items, max_broadcast=most).select("doc_id").toPandas()["doc_id"].dropna()) <= {3, 4}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_case_and_short_items(spark, most):
    docs = spark.createDataFrame([(1, f"intro {ITEM.lower()} more"), (2, ITEM.upper()), (3, ITEM.title()), (4, "Well, there are ONLY four words here to see"), (5, "he paid 7 kg and left the house"), (6, "a sack of 5 kg stood there")], "doc_id int, text string")
    items = spark.createDataFrame([(10, ITEM), (13, "only four words here"), (14, "5 kg")], "item_id int, text string")
    out = decontaminate.find(docs, items, max_broadcast=most).where("contaminated").collect()
    got = {(r.doc_id, r.item_id): r for r in out}
    assert {(1, 10), (2, 10), (3, 10), (4, 13), (6, 14)} <= set(got) and (5, 14) not in got
    assert all(got[d, 10].coverage == 1 and not got[d, 10].changed for d in (1, 2, 3))


def template(text):
    """(template words, plain words, is a slot) by the rules of the module, word by word."""
    import re

    out, plain, slots, before, begins = [], [], [], "", True
    for w in (text or "").split():
        core = w.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "%$"))
        low, tail = core.lower(), w.rstrip("\"')]}")[-1:]
        number = bool(re.match(r"[$£€]*[+-]?\d[\d.,:/]*%?$", core))
        unit = low.encode() in decontaminate.UNITS and before == "number" and not number
        name = len(core) > 1 and core[0].isupper() and core[1:2].islower() and not begins and not number and not unit
        kind = "number" if number else "unit" if unit else "name" if name else None
        out.append((kind,) if kind else low)
        plain.append(low)
        slots.append(kind is not None)
        before, begins = "number" if number else "", tail != "" and tail in ".!?:"
    return out, plain, slots


def plain_match(doc, item, k=5, least=0.8, consistent=0.8):
    """The best occurrence of an item in a document: (contaminated, coverage, consistency, same), or None."""
    (dt, dp, _), (it, ip, isl) = template(doc), template(item)
    m = min(k, len(ip))
    if not m or not dp:
        return None
    spots = range(len(ip) - m + 1)
    literal = {p: m - sum(isl[p : p + m]) for p in spots}
    places = [p for p in spots if literal[p] >= 2] or [*spots]
    hits = {}
    for p in places:
        for at in range(len(dp) - m + 1):
            whole = len(dp) == m or m == k
            if dp[at : at + m] == ip[p : p + m] or dt[at : at + m] == it[p : p + m] and (whole or literal[p] >= 2):
                hits[p, at - p] = [(ip[p + j], dp[at + j]) for j in range(m) if isl[p + j]]
    shifts = sorted({s for _, s in hits})
    runs, parts = [], [set(shifts), *({s} for s in shifts)]
    for s in shifts:
        if runs and s - max(runs[-1]) <= len(places) / 2 + 1:
            runs[-1].add(s)
        else:
            runs.append({s})
    best = None
    for part in parts + runs:
        own = {x: v for x, v in hits.items() if x[1] in part}
        coverage = len({p for p, _ in own}) / len(places)
        if coverage < least or not own:
            continue
        seen = {}
        for pairs in own.values():
            for a, b in pairs:
                seen.setdefault(a, {}).setdefault(b, 0)
                seen[a][b] += 1
        tops = {a: max((n, a == b) for b, n in bs.items()) for a, bs in seen.items()}
        rate = sum(n for n, _ in tops.values()) / sum(sum(bs.values()) for bs in seen.values()) if seen else 1.0
        found = (rate >= consistent, coverage, rate, all(same for _, same in tops.values()))
        best = found if best is None or found > best else best
    return best


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_brute_force(spark, sf, most):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()}
    items |= {1001: ITEM, 1002: OTHER, 1003: "only four words here", 1004: "5 kg", 1005: None, 1006: "1 2 3 4 5 6 7", 1007: "the answer to the question is the answer to the question"}
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text) < 1500][:25]
    texts += [f"{a} and so on {b}" for a in (ITEM, OTHER, BROKEN) for b in (ITEM.lower(), OTHER, "5 kg.", items[min(items)])]
    texts += [ITEM[:70], f"{ITEM[:60]} {'some words between them ' * 9} {ITEM[60:]}", "Only four words here", "7 kg", "1 2 3 4 5 6 7 8 9", "is the answer to the question is the answer to the question is", None, "", f"{ITEM} {OTHER} {BROKEN}"]
    texts += [t.replace(" the ", " The ") + " x" for t in list(items.values())[:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    frame = spark.createDataFrame(list(items.items()), "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.contaminated, round(r.coverage, 9), round(r.consistency, 9), not r.changed) for r in decontaminate.find(docs, frame, max_broadcast=most).collect()}
    want = {(d, i): x for d, t in enumerate(texts) for i, item in items.items() if (x := plain_match(t, item))}
    assert got == {key: (c, round(a, 9), round(b, 9), s) for key, (c, a, b, s) in want.items()} and len(want) > 25


def test_rows_go_by_their_own_text(spark):
    rows = [(None, ITEM), (None, "clean words"), (7, ITEM), (7, "other clean words"), (8, None), (8, ""), (9, ITEM), (9, ITEM)]
    docs = spark.createDataFrame([(i, t, "a", b"x") for i, t in rows], "doc_id int, text string, key string, _leaked binary")
    items = spark.createDataFrame([(1, ITEM)], "item_id int, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "clean words"), (7, "other clean words"), (8, None), (8, "")], key=str)
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_windows_that_all_share_propose_nothing(spark):
    common = "Choose the best of the following answers to the question below"
    items = spark.createDataFrame([(i, f"{common} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(40)], "item_id int, text string")
    own = decontaminate.item_windows(items, 5)
    keys = {r.h for r in decontaminate.proposing(own, 0.8).select("h").collect()}
    shared = {r.h for r in own.groupBy("h").count().where("count = 40").collect()}
    assert len(shared) == 7 and not keys & shared
    docs = spark.createDataFrame([(1, f"{common} something else"), (2, f"Well. {common} " + " ".join(f"w7x{j}" for j in range(20)))], "doc_id int, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()] == [(2, 7)]
