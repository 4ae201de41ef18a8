"""A bounded, reproducible sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, whole_id


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, held: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``most`` documents, in the order of a hash of their ids.

    Labels whose crc32(id as text) mod ``parts`` is ``held`` are not read. Null ids and labels are left out; where labels of an
    id differ the larger holds; of rows that repeat an id the least text is taken. The ids are at most ``most``, so they are broadcast, and
    the documents are scanned in place.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    own = own.where(crc_mod("id", parts) != held).groupBy("id").agg(F.max("label").alias("label"))
    picked = own.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(most)
    rows = docs.select(whole_id(docs, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return materialise(rows.join(F.broadcast(picked), "id").groupBy(F.col("id").alias("doc_id")).agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
