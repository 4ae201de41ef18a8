"""Helpers that the operators of this subpackage share: words, row keys, hot keys and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, ``[\x20\x09-\x0D]``. ``bytes.split()`` and ``bytes.strip()`` use the same six.
WHITE = " \t\n\x0b\x0c\r"

_OWN: dict[str, str] = {}
#: While a table is written, rows with whole texts travel to Python in batches of so many, unless the session has another number than Spark's own.
BATCH_ROWS = {"10000": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a folder of our own in a local session, and an error on a cluster, whose machines would each have another."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-concord-")
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts the lineage for good. The session's settings are as before afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS.get(size, size))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, size)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables from ``materialise`` that nothing reads any more.

    The driver's JVM is asked to collect what they leave: Spark drops the shuffles and broadcasts that made them only then, and
    the heap of a long chain of jobs shrinks again instead of staying as large as it ever was.
    """
    gone = [(df, path) for df in tables if (path := getattr(df, "__dict__", {}).get("_shared_path"))]
    for df, path in gone:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if gone:
        gone[0][0].sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_split(rows: DataFrame, side: DataFrame, keys: list[str], n_col: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which holds each key once with ``n_col``, its number of rows.

    Keys with at least one in ``share`` of all rows are ``share`` at most, so their part of ``side`` is broadcast and their rows
    stay where they are; the others are joined by a shuffle. ``rows`` is read twice.
    """
    total = side.agg(F.sum(n_col)).first()[0] or 0
    hot = F.col(n_col) * share >= total
    few = F.broadcast(side.where(hot))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(side.where(~hot), keys))


def pieces(batches, rows: int = 256):
    """The batches in pieces of at most ``rows`` rows, so that what Python makes of one stays small. Pieces are copies: a batch is free as soon as its last piece is out."""
    for b in batches:
        n = b.num_rows
        for at in range(0, n, rows):
            piece = b.take(pa.array(range(at, min(at + rows, n)), pa.int64()))
            if at + rows >= n:
                b = None
            yield piece
            piece = None
        pa.default_memory_pool().release_unused()


def whole_id(df: DataFrame, col: str):
    """Column: the ids as longs. Ids of another type than whole numbers are refused, as a cast would lose or fail on some."""
    kind = df.schema[col].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{col} is {kind.simpleString()}; ids must be whole numbers")
    return F.col(f"`{col}`").cast("long")


def digest_of(text_col: str):
    """Column: 128-bit digest of a text; null and empty texts share one."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


def crc_mod(doc_id, n: int):
    """Column: crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
