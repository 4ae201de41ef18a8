"""The registered query of each operator: whole tables, production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_model, licenses, lines, manifest, mixing, quality, repeats, secrets, simhash, toxicity, variants, vectors
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, sources = mixing.mix(table(spark, sf_dir, "documents"))
    named = chosen.withColumn("name", F.element_at("sources", 1))
    own = named.join(F.broadcast(sources.withColumnRenamed("name", "s")), F.col("name").eqNullSafe(F.col("s")))
    return own.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, least=0.8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    built = manifest.build(docs, manifest.leaf([*fields, F.col("text")]), {"tampered": manifest.leaf([*fields, tampered])})
    return manifest.digest(manifest.prove(built, "tampered"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.drop_repeats(table(spark, sf_dir, "documents"), length=100))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.word_counts(table(spark, sf_dir, "documents"), min_chars=6, min_n=5, drop_every=199), factor=5)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_decontamination, op4_toxicity, op5_quality, op6_line_dedup, op7_licenses, op8_language_model, op9_embeddings, op10_secrets, op11_manifest, op12_suffix_dedup, op13_variants)}

ORACLE: dict[str, str] = {
    "op6_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), k AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), f AS (
            SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), m AS (
            SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op9_embeddings": """
        WITH RECURSIVE p AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93
        ), r(u, v) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u
        ), n AS (SELECT u, count(*) AS n FROM p GROUP BY u), c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
        SELECT c.u AS vec_id, coalesce(n, 0) AS n_links, component_id, c.u = component_id AS kept FROM c LEFT JOIN n USING (u)
    """,
}
