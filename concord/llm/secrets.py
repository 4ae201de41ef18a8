"""Secret scans that weigh corpus-wide ownership.

Candidates are found by pattern in every whole text. The hash of each candidate's value is aggregated by the distinct
repositories and owners that hold it: a value that many owners hold is a widely copied example, one that a single owner holds in
a few repositories and that looks random is taken for a live credential. The corpus then also says which otherwise unmarked
tokens are credentials.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, materialise, pieces, whole_id

#: Base patterns. A match counts if its value has the least length given.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: Further candidates, which count only if ownership says that they are live.
MORE = (
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("prefixed", re.compile(r"\b(?:gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza)[A-Za-z0-9_-]{16,}", re.A), 0),
    ("url", re.compile(r"://[^\s:/@]+:([^\s:/@]{6,})@"), 1),
    ("random", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"), 0),
)
#: What a random token has to hold.
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
ORDER = [k for k, *_ in BASE] + [k for k, *_ in MORE]


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


class Taken:
    """Disjoint spans in order; a span is looked up by bisection."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        at = bisect_right(self.ends, s)
        return at < len(self.starts) and self.starts[at] < e

    def spans(self):
        return zip(self.starts, self.ends)


def find(text: str | None) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int, str]]]:
    """Base matches and further candidates of a text: (kind, start, end, value), offsets in code points, end exclusive.

    Further candidates do not overlap base matches or those of the kinds before theirs.
    """
    base, more = [], []
    if not text:
        return base, more
    for kind, pattern, group, least in BASE:
        base += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    taken = Taken((s, e) for _, s, e, _ in base)
    for kind, pattern, group in MORE:
        own = []
        for m in pattern.finditer(text):
            s, e = m.span(group)
            if kind == "random" and not (_DIGIT.search(m[0]) and _LETTER.search(m[0])):
                continue
            if not taken.meets(s, e):
                own.append((kind, s, e, m[group]))
        if own:
            more += own
            taken = Taken([*taken.spans(), *((s, e) for _, s, e, _ in own)])
    return base, more


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(uid, doc_id, owner, base, found): one row per row of ``docs`` with all its candidates.

    ``uid`` numbers the rows, so that repeated ids stay apart; the result is written before use, which fixes it.
    """

    def run(batches):
        for b in pieces(batches):
            bases, found = [], []
            for t in b.column(3).to_pylist():
                base, more = find(t)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in base])
                found.append([{"kind": k, "start": s, "end": e, "h": xxhash.xxh3_128_digest(v.encode()), "bits": entropy(v)} for k, s, e, v in base + more])
            span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bases, pa.list_(pa.struct(span))), pa.array(found, pa.list_(pa.struct([*span, ("h", pa.binary()), ("bits", pa.float64())])))], ["uid", "doc_id", "owner", "base", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), whole_id(docs, id_col).alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span = "kind string, start int, end int"
    return materialise(rows.mapInArrow(run, f"uid long, doc_id long, owner string, base array<struct<{span}>>, found array<struct<{span}, h binary, bits double>>"), "secrets")


def ownership(flat: DataFrame) -> DataFrame:
    """(h, n, n_owners, n_repos) from ``flat(h, owner, doc_id, uid)``: how often each candidate value stands, and its distinct owners and repositories.

    A document stands for a repository of its owner, a row with a null id for one of its own; a null owner counts as one. Rows are
    counted by (value, owner, repository) first, so a value that a third of all documents hold arrives as partial counts.
    """
    repo = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("uid")).alias("uid"))
    per = flat.groupBy("h", "owner", repo.alias("repo")).agg(F.count("*").alias("n"))
    owners = per.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return owners.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, max_owners: int = 1, max_repos: int = 3, min_bits: float = 3.0, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(doc_id, base, spans) for every row: base matches, and those with the live-looking candidates of the method added.

    ``spans`` is an array of (kind, start, end, base, live, n_owners, n_repos). ``live``: at most ``max_owners`` owners and
    ``max_repos`` repositories hold the value, and its entropy is ``min_bits`` or more a character. Candidates that are neither
    base nor live are left out. A null or empty text has no spans. Rows are kept one to one, repeated and null ids included; each
    row with a null id is a repository of its own. Other columns are ignored. An empty table gives an empty result.
    """
    rows = candidates(docs, id_col, text_col, owner_col)
    flat = rows.select("uid", "doc_id", "owner", F.size("base").alias("n_base"), F.posexplode("found")).select("uid", "doc_id", "owner", (F.col("pos") < F.col("n_base")).alias("base"), "col.*")
    owned = materialise(ownership(flat.select("h", "owner", "doc_id", "uid")), "owners")
    held = join_split(flat.drop("doc_id", "owner"), owned, ["h"], "n").drop("n")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos) & (F.col("bits") >= min_bits)
    kept = held.withColumn("live", live).where("base or live")
    spans = kept.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end", "base", "live", "n_owners", "n_repos")).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, "uid", "left").select("doc_id", "base", F.coalesce("spans", empty).alias("spans"))


def _span_text(spans):
    """Column: kind:start:end by start, then kind as listed, joined by commas."""
    rank = F.create_map(*[x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))])
    sort = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(sort, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The rows of the contract from those of ``scan``."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))
