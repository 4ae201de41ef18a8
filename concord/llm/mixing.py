"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by membership pattern; the patterns' tokens are routed to the
sources' quotas, where a second and third pass over the same tokens cost more each (convex repetition costs); then seeded
documents fill each pattern's routed amount. Only one row for each pattern and each source reaches the driver, never documents;
what it decides is a seeded cut for each pattern, by which every row finds its own number of copies without moving.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, whole_id

#: Words by the contract.
WORD = r"[^\x20\x09-\x0D]+"


def fill_targets(sizes: list[int], weights: list[float], most: float = 3.0, total: float | None = None) -> list[float]:
    """Shares of the total (default: of all sizes) by weight, none above ``most`` times its source's size; the excess is shared again by weight."""
    total, free, out = float(sum(sizes) if total is None else total), {*range(len(sizes))}, [0.0] * len(sizes)
    while free and total > 0:
        unit = total / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            total -= out[i]
            free.discard(i)
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = 3) -> list[dict[int, int]]:
    """Tokens of each pattern routed to each source: as much as quotas take, at the least repetition cost.

    ``patterns``: (sources, tokens). Pass number r over a pattern's tokens costs r - 1 a token, so a flow of minimum cost repeats
    only what it must. Successive shortest paths, each step sending a blocking flow over all arcs of least cost.
    """
    n, s = len(patterns), len(quotas)
    source, sink = 0, n + s + 1
    arcs: list[list[int]] = []  # to, capacity left, cost
    out: dict[int, list[int]] = defaultdict(list)

    def arc(a: int, b: int, cap: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, cap, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    routes = []
    for p, (members, tokens) in enumerate(patterns, 1):
        for r in range(most):
            arc(source, p, tokens, r)
        routes.append({m: arc(p, n + 1 + m, tokens * most, 0) for m in members})
    for m, q in enumerate(quotas):
        arc(n + 1 + m, sink, q, 0)
    height = [0] * (sink + 1)
    while True:
        dist = {source: 0}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, cap, cost = arcs[e]
                if cap > 0 and (x := d + cost + height[a] - height[b]) < dist.get(b, 1 << 60):
                    dist[b] = x
                    heapq.heappush(heap, (x, b))
        if sink not in dist:
            break
        far = max(dist.values())
        for a in range(sink + 1):
            height[a] += dist.get(a, far)
        tight = lambda a, e: arcs[e][1] > 0 and arcs[e][2] + height[a] - height[arcs[e][0]] == 0
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if tight(a, e) and arcs[e][0] not in level:
                        level[arcs[e][0]] = level[a] + 1
                        queue.append(arcs[e][0])
            if sink not in level:
                break
            at: dict[int, int] = defaultdict(int)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    flow = min(arcs[e][1] for e in path)
                    for e in path:
                        arcs[e][1] -= flow
                        arcs[e ^ 1][1] += flow
                    path, node = [], source
                while at[node] < len(out[node]):
                    e = out[node][at[node]]
                    if tight(node, e) and level.get(arcs[e][0]) == level[node] + 1:
                        break
                    at[node] += 1
                else:
                    if node == source:
                        break
                    level[node] = -1
                    node = arcs[path.pop() ^ 1][0]
                    at[node] += 1
                    continue
                path.append(e)
                node = arcs[e][0]
    return [{m: arcs[e ^ 1][1] for m, e in held.items() if arcs[e ^ 1][1]} for held in routes]


#: Stands for a null id.
NO_ID = -(1 << 62)


@dataclass(frozen=True)
class Plan:
    """``patterns(m, p, passes, cut)``: rows below the seeded cut get a pass more, as do those of ``more(p, id, u, size)``. Both are bounded by the number of patterns."""

    patterns: DataFrame
    more: DataFrame
    sources: DataFrame


def _cuts(rows: DataFrame, rest: dict[int, int], bins: int = 1024, rounds: int = 4) -> tuple[dict[int, int], list[tuple]]:
    """The cut of each pattern p below which sizes sum to at most ``rest[p]``, and the rows that are taken beyond it.

    ``rows`` has one row for each (p, id, u, size) and its number of copies n, all taken or none but at the edge. The cut in the
    seeded order is found by sums over ever finer bins (pre-aggregated), so no pattern's documents meet in one task; the gap that
    is left at the cut is then narrowed by the row whose size is nearest to it, one each round.
    """
    spark = rows.sparkSession
    low = dict.fromkeys(rest, 0)
    left = dict(rest)
    width = 1 << 32
    while width > 1 and low:
        step = max(1, width // bins)
        edge = spark.createDataFrame([(p, low[p], low[p] + width, left[p]) for p in low], "p int, a long, b long, gap long")
        inside = rows.join(F.broadcast(edge), "p").where("u >= a and u < b").groupBy("p", "gap", F.floor((F.col("u") - F.col("a")) / step).alias("bin")).agg(F.sum(F.col("size") * F.col("n")).alias("t"))
        summed = inside.withColumn("upto", F.sum("t").over(Window.partitionBy("p").orderBy("bin")))
        cut = summed.groupBy("p").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("bin"))).alias("bin"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("used"))
        at = {r.p: r for r in cut.collect()}
        for p in low:
            r = at.get(p)
            left[p] -= int(r.used or 0) if r else 0
            low[p] += step * (int(r.bin) if r and r.bin is not None else -(-width // step))
        width = step
    more: list[tuple] = []
    for _ in range(rounds):
        gaps = spark.createDataFrame([(p, low[p], left[p]) for p in low if left[p] > 0] or [(-1, 0, 0)], "p int, a long, gap long")
        fits = rows.join(F.broadcast(gaps), "p").where("u >= a and size > 0 and size * n < 2 * gap")
        if more:
            fits = fits.join(F.broadcast(spark.createDataFrame(more, MORE)), ["p", "id", "u", "size"], "left_anti")
        best = fits.groupBy("p").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size") * F.col("n")), "u", "id", "size", (F.col("size") * F.col("n")).alias("all"))).alias("x")).collect()
        for r in best:
            left[r.p] -= r.x["all"]
            more.append((r.p, r.x["id"], r.x["u"], r.x["size"]))
        if not best:
            break
    return low, more


MORE = "p int, id long, u long, size long"


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, member_col: str):
    """Columns (id, size, m, u) of a row: its id, words, sorted sources and place in the seeded order."""
    member = F.col(f"`{member_col}`")
    if docs.schema[member_col].dataType.typeName() != "array":
        member = F.array(member.cast("string"))
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sources = F.array_sort(F.array_distinct(F.coalesce(member, F.array(F.lit(None).cast("string")))))
    key = F.coalesce(whole_id(docs, id_col), F.lit(NO_ID))
    return key, size, sources, lambda i, n: F.pmod(F.xxhash64(F.lit(seed), i, n), F.lit(1 << 32))


def _with_copies(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows(id, size, m, u, ..)`` with ``copies``: both sides of the plan are broadcast, so no row moves."""
    own = rows.join(F.broadcast(plan.patterns), "m").join(F.broadcast(plan.more.withColumn("more", F.lit(1))), ["p", "id", "u", "size"], "left")
    extra = F.when((F.col("u") < F.col("cut")) | F.col("more").isNotNull(), 1).otherwise(0)
    return own.withColumn("copies", (F.col("passes") + extra).cast("int")).drop("p", "passes", "cut", "more")


def _plan(rows: DataFrame, weights, most: int, max_patterns: int) -> Plan:
    """The plan for ``rows(id, size, m, u)``."""
    spark = rows.sparkSession
    found = rows.groupBy("m").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than max_patterns={max_patterns} membership patterns")
    in_order = lambda x: (x is None, (x or "").encode())
    found.sort(key=lambda r: [in_order(x) for x in r.m])
    names = sorted({x for r in found for x in r.m}, key=in_order)
    place = {x: i for i, x in enumerate(names)}
    held = [0] * len(names)
    for r in found:
        for x in r.m:
            held[place[x]] += r.size
    targets = fill_targets(held, list(weights(names)) if weights else [1 + i % 3 for i in range(len(names))], most, sum(r.size for r in found))
    routed = route([(tuple(place[x] for x in r.m), r.size) for r in found], [round(t) for t in targets], most)
    sent = [sum(x.values()) for x in routed]
    rest = {i: sent[i] % r.size for i, r in enumerate(found) if r.size and sent[i] % r.size}
    low, more = {}, []
    if rest:
        open_ = spark.createDataFrame([(i, found[i].m) for i in rest], "p int, m array<string>")
        distinct = materialise(rows.join(F.broadcast(open_), "m").groupBy("p", "id", "u", "size").agg(F.count("*").alias("n")), "distinct")
        low, more = _cuts(distinct, rest)
        release(distinct)
    patterns = spark.createDataFrame([(r.m, i, sent[i] // r.size if r.size else 1, low.get(i, 0)) for i, r in enumerate(found)], "m array<string>, p int, passes int, cut long")
    return Plan(patterns, spark.createDataFrame(more, MORE), spark.createDataFrame([(x, held[i], targets[i]) for x, i in place.items()], "name string, source_size long, target double"))


def mix(docs: DataFrame, weights=None, most: int = 3, seed: int = 17, max_patterns: int = 200_000, id_col: str = "doc_id", text_col: str = "text", member_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, sources, copies) for every row of ``docs``, and (name, source_size, target) for every source.

    A document gives ``copies`` x ``size`` words to the mix. ``member_col`` is a source name or an array of them; null is a source
    of its own, last in order; an empty array belongs to no source and is never taken. ``weights(names) -> list`` weighs the
    sources in code point order (default: 1, 2, 3, repeating). Targets share the whole size by weight, at most ``most`` times the
    size of a source. Rows of equal id, sources and size are chosen together, rows that differ in one of them apart. Empty texts
    have size 0; what happens to them changes no sum. An empty table gives empty results. Other columns are ignored. Reruns
    agree, by ``seed``.
    More than ``max_patterns`` membership patterns raise an error, as the flow over patterns runs on the driver.
    """
    key, size, sources, order = _keyed(docs, seed, id_col, text_col, member_col)
    rows = materialise(docs.select(key.alias("id"), size.alias("size"), sources.alias("m")).withColumn("u", order("id", "size")), "sizes")
    plan = _plan(rows, weights, most, max_patterns)
    chosen = _with_copies(rows, plan)
    return chosen.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "size", F.col("m").alias("sources"), "copies"), plan.sources


def take(docs: DataFrame, weights=None, most: int = 3, seed: int = 17, max_patterns: int = 200_000, id_col: str = "doc_id", text_col: str = "text", member_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, with ``copies``, the number of times each is repeated; a column of that name is replaced.

    Each row carries its own decision: rows that repeat an id with another text or source are decided apart.
    """
    key, size, sources, order = _keyed(docs, seed, id_col, text_col, member_col)
    rows = materialise(docs.select(key.alias("id"), size.alias("size"), sources.alias("m")).withColumn("u", order("id", "size")), "sizes")
    plan = _plan(rows, weights, most, max_patterns)
    release(rows)
    docs = docs.drop("copies")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"), size.alias("size"), sources.alias("m")).withColumn("u", order("id", "size"))
    return _with_copies(packed, plan).where("copies > 0").select("row.*", "copies")
