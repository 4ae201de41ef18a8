"""Writes that may be repeated: each run of a load has an id, and however often it is tried, its rows stand in the target once."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checked(run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", run_id):
        raise ValueError(f"a run id has letters, digits, - and _ only: {run_id!r}")
    return run_id


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> dict[str, dict]:
    """The manifest of each run that was committed: run id to attempt and number of rows."""
    at, fs = _files(spark, f"{path}/_commits")
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")]
    if not names:
        return {}
    texts = spark.read.text(f"{path}/_commits/*.json", wholetext=True).collect()
    return {m["run"]: m for m in (json.loads(r.value) for r in texts)}


def commit_run(df: DataFrame, path: str, run_id: str, format: str = "parquet") -> int:
    """Write ``df`` as the rows of ``run_id`` below ``path``; the number of rows.

    The attempt goes into a folder of its own. Only when all of it is there its manifest takes the place of the run's, in one
    rename: readers see the former attempt or this one, never both and never half of one. What a failed attempt leaves behind is
    read by nobody.
    """
    spark, run = df.sparkSession, _checked(run_id)
    attempt = uuid.uuid4().hex
    before = _commits(spark, path).get(run)
    df.write.format(format).save(f"{path}/attempts/{run}/{attempt}")
    n = spark.read.format(format).schema(df.schema).load(f"{path}/attempts/{run}/{attempt}").count()
    manifest, (fresh, fs) = json.dumps({"run": run, "attempt": attempt, "rows": n, "format": format}), _files(spark, f"{path}/_commits/.{run}-{attempt}")
    out = fs.create(fresh, True)
    out.write(bytearray(manifest.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{run}.json"), options)
    if before:
        old, fs = _files(spark, f"{path}/attempts/{run}/{before['attempt']}")
        fs.delete(old, True)
    return n


def read_runs(spark: SparkSession, path: str, schema, runs: list[str] | None = None) -> DataFrame:
    """The rows of the committed runs (of ``runs``, if given) with their ``run_id``."""
    held = {r: m for r, m in _commits(spark, path).items() if runs is None or r in runs}
    out = spark.createDataFrame([], schema).withColumn("run_id", F.lit(""))
    for kind in sorted({m["format"] for m in held.values()}):
        some = [f"{path}/attempts/{r}/{m['attempt']}" for r, m in held.items() if m["format"] == kind]
        rows = spark.read.format(kind).schema(schema).load(some)
        out = out.unionByName(rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"/attempts/([^/]+)/", 1)))
    return out


def drop_leftovers(spark: SparkSession, path: str) -> int:
    """Delete attempts that no manifest names; not while a run is being written. The number deleted."""
    held, n = {(r, m["attempt"]) for r, m in _commits(spark, path).items()}, 0
    at, fs = _files(spark, f"{path}/attempts")
    for run in fs.listStatus(at) if fs.exists(at) else []:
        for attempt in fs.listStatus(run.getPath()):
            if (run.getPath().getName(), attempt.getPath().getName()) not in held:
                fs.delete(attempt.getPath(), True)
                n += 1
    return n


def commit_rows(df: DataFrame, options: dict, table: str, run_id: str, run_column: str = "run_id") -> int:
    """Put the rows of a run into a database table that has a ``run_column``; the number of rows.

    Tasks write into a staging table of the run, made anew by each try. One transaction then deletes the run's rows from the target
    and copies the staged ones, so a task or a driver that dies in between leaves the target as it was, and a second try replaces
    the first.
    """
    spark, run = df.sparkSession, _checked(run_id)
    staging = f"{table}_stage_{re.sub('[^A-Za-z0-9]', '_', run)}"
    df.write.format("jdbc").options(**options, dbtable=staging).mode("overwrite").save()
    if driver := options.get("driver"):
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    props = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            props.setProperty(k, options[k])
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], props)
    quote = connection.getMetaData().getIdentifierQuoteString().strip()
    names = ", ".join(f"{quote}{c}{quote}" for c in df.columns)
    try:
        connection.setAutoCommit(False)
        gone = connection.prepareStatement(f"DELETE FROM {table} WHERE {quote}{run_column}{quote} = ?")
        gone.setString(1, run)
        gone.executeUpdate()
        put = connection.prepareStatement(f"INSERT INTO {table} ({names}, {quote}{run_column}{quote}) SELECT {names}, CAST(? AS VARCHAR(200)) FROM {staging}")
        put.setString(1, run)
        n = put.executeUpdate()
        connection.commit()
        connection.createStatement().executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
    return n
