"""Quality by compression: texts are compressed with a zstandard dictionary of good and one of bad text.

The difference of the two compressed sizes, divided by the text's size, says which kind of text it resembles; a logistic curve
fitted on labelled documents that built no dictionary turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, pieces, sigmoid, whole_id
from .labelled import labelled_sample


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (empty: none), bytes of a block, compression level, and the curve's slope and offset."""

    good: bytes
    bad: bytes
    block: int
    level: int
    slope: float
    offset: float


class Compressors:
    def __init__(self, model: QualityModel):
        self.model = model
        self.both = [zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_dict_id=False, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {})) for d in (model.good, model.bad)]

    def difference(self, text: bytes | None) -> float:
        """(size with bad - size with good) / bytes of the text, over all its blocks; 0 for an empty text."""
        if not text:
            return 0.0
        total, (good, bad) = 0, self.both
        for at in range(0, len(text), self.model.block):
            piece = text[at : at + self.model.block]
            total += len(bad.compress(piece)) - len(good.compress(piece))
        return total / len(text)

    def score(self, text: bytes | None) -> float:
        return float(sigmoid(self.model.slope * self.difference(text) + self.model.offset))


def _blocks(sample: DataFrame, where: str, block: int, most: int) -> list[bytes]:
    """At most ``most`` blocks of the sample's texts, in the order of a hash."""

    def run(batches):
        for b in pieces(batches):
            cut = [t[at : at + block] for t in b.column(0).to_pylist() for at in range(0, len(t), block)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["x"])

    cut = sample.where(where).select(F.col("text").cast("binary")).mapInArrow(run, "x binary")
    return [bytes(r.x) for r in cut.orderBy(F.xxhash64("x"), "x").limit(most).collect()]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps with a slight pull to zero, on standardised x; a single class gives its smoothed rate."""
    if not 0 < y.sum() < len(y):
        rate = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(rate / (1 - rate)))
    mean, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (p - y) + 1e-3 * w)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 4, held: int = 2, most: int = 12_000, block: int = 2048, blocks: int = 4000, dictionary: int = 32_768, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``most`` labelled documents and ``blocks`` blocks of each class; labels with crc32 mod ``parts`` = ``held`` are not read.

    One half of the sample builds the dictionaries and the other the curve. Where a class has too little text for zstandard to
    train on, its blocks themselves are the dictionary, up to ``dictionary`` bytes; a class without text gives none. Without both
    classes the score is their smoothed rate. Empty tables give a model that scores every text alike, 0.5.
    """
    sample = labelled_sample(docs, labels, label_col, parts, held, most, id_col, text_col).withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)))
    dicts = []
    for where in ("half = 0 and label > 0", "half = 0 and label <= 0"):
        cut = _blocks(sample, where, block, blocks)
        try:
            dicts.append(zstandard.train_dictionary(dictionary, cut, level=level).as_bytes())
        except zstandard.ZstdError:  # too little text to train on
            dicts.append(b"".join(cut)[:dictionary])
    model = QualityModel(*dicts, block, level, 0.0, 0.0)

    def run(batches):
        own = Compressors(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([own.difference(t) for t in b.column(0).to_pylist()], pa.float64())], ["label", "x"])

    rows = sample.where("half = 1").select(F.col("text").cast("binary"), "label").mapInArrow(run, "label int, x double").collect()
    x, y = np.array([r.x for r in rows], float), np.array([r.label > 0 for r in rows], float)
    order = np.lexsort((y, x))  # sums that do not depend on the order of the tasks
    slope, offset = logistic(x[order], y[order])
    return QualityModel(*dicts, block, level, slope, offset)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, difference, score) for every row; null and empty texts have difference 0.

    Long texts are compressed whole, block by block, and the difference is a mean over their bytes. Repeated rows and rows with a
    null id are scored like any other. Other columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = Compressors(held.value)
        for b in pieces(batches):
            x = np.array([own.difference(t) for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array(sigmoid(own.model.slope * x + own.model.offset))], ["doc_id", "difference", "score"])

    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, difference double, score double")


def digest(scored: DataFrame, parts: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    return scored.select("doc_id", (crc_mod("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
