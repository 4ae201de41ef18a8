"""Toxicity by multiple-instance learning.

Only whole documents carry labels. Each sentence gets a probability from its words, a document is toxic if any sentence is
(noisy-or: 1 minus the product of the sentences' complements), and the weights are fitted to the documents' labels. The fitted
sentence scores then locate the offending sentences.

Length must not make a text toxic: sentences of equal features are one piece of evidence, and those under ``FLOOR``, which all
sentences without a known feature are, together count for less than one sentence of that probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, pieces, sigmoid, whole_id, words_of
from .labelled import labelled_sample
from .simhash import shingle_hashes

_SENTENCE = re.compile(rb"[^.!?\n]+")
#: Pull of the weights to where they start. Where several words of a document tell its label, noisy-or needs but one; this keeps the others.
PULL = 1e-4
#: Sentences under this probability add up to less than it.
FLOOR = 0.01
#: Weighted counts are summed as whole numbers of this part, so that sums do not depend on the order of the tasks.
UNIT = 1 << 20
_PUNCT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature, and the bias of a sentence."""

    weights: dict[bytes, float]
    bias: float


def features(word: bytes) -> tuple[bytes, ...]:
    """The word, and its first four to six bytes as far as it has them."""
    return (word, *(b"^" + word[:n] for n in (4, 5, 6) if len(word) >= n))


def sentences(text: bytes) -> list[tuple[int, int, set[bytes]]]:
    """(start, end, words) of each sentence, in bytes of the text."""
    return [(m.start(), m.end(), set(words)) for m in _SENTENCE.finditer(text.lower()) if (words := m[0].translate(_PUNCT).split())]


def copy_weights(sample: DataFrame, k: int = 3, views: int = 4) -> dict[int, float]:
    """Weight of each document of the bounded sample: 1 by the number of those that share a min-wise key with it.

    So a much copied document counts once, and its rare words do not pass for signs of its label.
    """

    def run(batches):
        for b in pieces(batches):
            keys = []
            for t in b.column(1).to_pylist():
                hashes = shingle_hashes(words_of(t), k)
                keys.append([int((hashes * np.uint64(2 * v + 1) + (hashes >> np.uint64(17 + v))).min().view(np.int64)) if len(hashes) else v for v in range(views)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    rows = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>").toArrow()
    keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(-1, views) if rows.num_rows else np.empty((0, views), np.int64)
    most = np.ones(len(keys), np.int64)
    for column in keys.T:
        _, at, n = np.unique(column, return_inverse=True, return_counts=True)
        most = np.maximum(most, n[at])
    return dict(zip(rows["doc_id"].to_pylist(), (1.0 / most).tolist()))


def _vocabulary(sample: DataFrame, weights, size: int) -> dict[bytes, float]:
    """The ``size`` features most tied to the label by chi-squared over weighted document counts, each with the weight it starts from.

    That is the smoothed log odds of the label, less where few documents speak for it, and less for a part of a word.
    """

    def run(batches):
        counts: dict[bytes, list[float]] = {}
        for b in pieces(batches):
            for i, t, y in zip(*(b.column(j).to_pylist() for j in range(3))):
                for f in {f for _, _, ws in sentences(t.encode()) for w in ws for f in features(w)}:
                    own = counts.setdefault(f, [0, 0, 0])
                    own[y > 0] += round(weights.value[i] * UNIT)
                    own[2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *(pa.array([c[j] for c in counts.values()], pa.int64()) for j in range(3))], ["f", "n0", "n1", "n"])

    per = sample.select("doc_id", "text", "label").mapInArrow(run, "f binary, n0 long, n1 long, n long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n")])
    per = per.withColumns({c: F.col(c) / UNIT for c in ("n0", "n1")})
    t0, t1 = (sum(weights.value[r.doc_id] for r in sample.where(c).select("doc_id").collect()) for c in ("label <= 0", "label > 0"))
    n, seen = t0 + t1, F.col("n0") + F.col("n1")
    tie = F.pow(F.col("n1") * (t0 - F.col("n0")) - F.col("n0") * (t1 - F.col("n1")), F.lit(2)) * n / (seen * (n - seen + 1) * max(t0, 1) * max(t1, 1))
    top = per.where(F.col("n") >= 3).orderBy(F.round(tie, 9).desc(), "f").limit(size).collect()
    odds = lambda r: np.log((r.n1 + 0.5) / (t1 + 1)) - np.log((r.n0 + 0.5) / (t0 + 1))
    return {bytes(r.f): float(max(odds(r), 0) * min(1, r.n1 / 8) * (0.4 if r.f[:1] == b"^" else 1)) for r in top}


def evidence(p: np.ndarray, doc: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minus log of the chance that no sentence of a document is toxic, how much each sentence moves it, how much ``plain`` does).

    ``p``: probabilities of the different sentences of ``doc``. Those at ``FLOOR`` or more are multiplied; the sum x of the others,
    with that of the sentences without a known feature in ``plain``, counts as one of FLOOR * (1 - exp(-x / FLOOR)).
    """
    high, n = p >= FLOOR, len(plain)
    low = (np.bincount(doc, np.where(high, 0.0, p), n) + plain) / FLOOR
    rest = -FLOOR * np.expm1(-low)
    total = np.bincount(doc, np.where(high, -np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0), n) - np.log1p(-rest)
    slow = np.exp(-low)
    return total, np.where(high, 1.0, slow[doc]), slow


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 3, held: int = 1, most: int = 12_000, size: int = 1024, rounds: int = 500, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``most`` labelled documents and ``size`` features; labels with crc32 mod ``parts`` = ``held`` are not read.

    Copies among them share the weight of one document. Without positive or negative labels, empty tables included, no feature is
    known and every text scores under ``FLOOR``.
    """
    sample = labelled_sample(docs, labels, label_col, parts, held, most, id_col, text_col)
    weights = copy_weights(sample)
    start = _vocabulary(sample, sample.sparkSession.sparkContext.broadcast(weights), size)
    place = {f: i for i, f in enumerate(start)}

    def run(batches):
        for b in pieces(batches):
            ids, sizes, plain = [], [], []
            for t in b.column(2).to_pylist():
                all_sets = [tuple(sorted({place[f] for w in ws for f in features(w) if f in place})) for _, _, ws in sentences(t.encode())]
                sets = sorted({*all_sets} - {()})
                plain.append(all_sets.count(()))
                ids.append([x for own in sets for x in own])
                sizes.append([len(own) for own in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), pa.array(plain, pa.int64())], ["doc_id", "label", "ids", "sizes", "plain"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ids array<int>, sizes array<int>, plain long").toArrow().sort_by("doc_id")
    y = (rows["label"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel({}, -12.0)
    ids, sizes = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("ids", "sizes"))
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(rows["sizes"]).to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    plain = rows["plain"].to_numpy().astype(float)
    share = np.array([weights[i] for i in rows["doc_id"].to_pylist()])
    share /= share.sum()
    w0 = np.array([*start.values()], float)
    w, bias = w0.copy(), -7.0
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(row, w[ids], len(sizes)) + bias)
        p0 = float(sigmoid(bias))
        total, moves, slow = evidence(p, doc, plain * p0)
        whole = np.clip(-np.expm1(-total), 1e-9, 1 - 1e-9)
        pull = ((1 - y) - y * (1 - whole) / whole) * share  # d loss / d total
        per = pull[doc] * p * moves
        grad = np.append(np.bincount(ids, per[row], len(place)), per.sum() + (pull * slow * plain).sum() * p0)
        grad[:-1] += PULL * (w - w0)
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-6}, float(bias))


class Scorer:
    """Sentence and document probabilities under a model; keeps the weights of words it has seen."""

    def __init__(self, model: ToxicityModel, most: int = 100_000):
        self.model, self.most, self.seen = model, most, {}

    def _hits(self, word: bytes) -> tuple[bytes, ...]:
        if (hit := self.seen.get(word)) is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            hit = self.seen[word] = tuple(f for f in features(word) if f in self.model.weights)
        return hit

    def sentence_scores(self, text: str | bytes | None) -> list[tuple[int, int, float, frozenset]]:
        """(start, end, probability, known features) of each sentence, in bytes."""
        weights, bias, out = self.model.weights, self.model.bias, []
        for s, e, ws in sentences((text.encode() if isinstance(text, str) else text) or b""):
            hit = frozenset(f for w in ws for f in self._hits(w))
            out.append((s, e, sum(weights[f] for f in sorted(hit)) + bias, hit))
        p = sigmoid(np.array([z for _, _, z, _ in out]))
        return [(s, e, float(q), hit) for (s, e, _, hit), q in zip(out, p)]

    def score(self, scored: list[tuple[int, int, float, frozenset]]) -> float:
        """Noisy-or of the different sentences; 0 without any."""
        if not scored:
            return 0.0
        known = {hit: q for _, _, q, hit in scored}
        known.pop(frozenset(), None)
        plain = np.array([sum(q for _, _, q, hit in scored if not hit)])
        return float(-np.expm1(-evidence(np.array([*known.values()], float), np.zeros(len(known), int), plain)[0][0]))


def score(docs: DataFrame, model: ToxicityModel, offending: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sentences) for every row: the noisy-or score, and the offending sentences.

    ``sentences`` is an array of (start, end, score, text), for sentences at ``offending`` or more, offsets in UTF-8 bytes.
    Null and blank texts score 0 and have none; texts without a known feature score under ``FLOOR``, however long. Repeated rows are
    scored alike; rows with a null id are scored, too. Other columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for b in pieces(batches):
            scores, spans = [], []
            for t in b.column(1).to_pylist():
                own = scorer.sentence_scores(t)
                scores.append(scorer.score(own))
                spans.append([{"start": s, "end": e, "score": q, "text": t[s:e].decode("utf-8", "replace").strip()} for s, e, q, _ in own if q >= offending])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "sentences"])

    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, sentences array<struct<start int, end int, score double, text string>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``least``, all columns unchanged.

    Null and blank texts stay; repeated rows stay or go alike, whatever their ids. An empty table gives an empty result.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(held.value)
        for b in pieces(batches):
            yield b.filter(pa.array([scorer.score(scorer.sentence_scores(t)) < least for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(scored: DataFrame, parts: int = 3, held: int = 1, least: float = 0.7) -> DataFrame:
    return scored.select("doc_id", (crc_mod("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
