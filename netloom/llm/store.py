"""Shared-folder tables and session settings that the text operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or in a local session without it a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df once in the shared folder and reads it back: the lineage ends there and a lost executor costs nothing.

    What `drop` doesn't delete before goes when the driver ends.
    """
    path = f"{shared_dir(spark)}/netloom/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _folder(spark, path, "deleteOnExit")
    out = spark.read.schema(df.schema).parquet(path)
    out.netloom_path = path
    return out


def _folder(spark: SparkSession, path: str, action: str, *more) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), action)(where, *more)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `table`. Only for those that no later plan reads: what follows from them must be written."""
    for df in tables:
        _folder(df.sparkSession, df.netloom_path, "delete", True)


#: rows and bytes of a batch that goes to a Python worker; the same for all operators, as Spark reads them when it runs
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that one Arrow batch brings to a Python worker, so that long texts can't fill its memory.

    Also lets new workers import this package from where the driver has it, if they see that folder.
    """
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, known)))
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """The columns by name, whatever characters these hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def with_key(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text, ...) -> (key, row) with a number that names each different document, and the keys of the odd ones.

    row is the whole row as one struct, so that no column of docs can clash with a name of ours; `row.*` gives it back.
    The key is doc_id where that is in one row only. Rows that repeat a doc_id or have none are told apart by doc_id and
    SHA-256 of the text, nulls apart from empty texts, and get numbers below all ids; the second result holds these
    as (key, doc_id, digest), or is None if all ids are single. Only ids are shuffled if they are.
    """
    ids = docs.select(F.col("doc_id").alias("odd_id"))
    more = table(spark, ids.groupBy("odd_id").agg(F.count("*").alias("n")).where("n > 1 or odd_id is null").select("odd_id"), "odd_ids")
    if more.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*columns_of(docs)).alias("row")), None
    digest = F.coalesce(F.sha2("text", 256), F.lit("null"))
    own = docs.select(F.col("doc_id").alias("own_id"), digest.alias("own_digest"))
    odd = own.join(more, F.expr("own_id <=> odd_id"), "left_semi").select(F.col("own_id").alias("odd_id"), F.col("own_digest").alias("digest")).distinct()
    below = docs.agg(F.least(F.min(F.col("doc_id").cast("long")), F.lit(0))).first()[0] or 0
    odd = table(spark, odd.withColumn("odd_key", F.lit(below - 1) - F.monotonically_increasing_id()), "odd_keys")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id").alias("own_id"), digest.alias("own_digest"))
    keyed = rows.join(odd, F.expr("own_id <=> odd_id and own_digest = digest"), "left")
    keyed = keyed.select(F.coalesce("odd_key", F.col("own_id").cast("long")).alias("key"), "row")
    return keyed, odd.select(F.col("odd_key").alias("key"), F.col("odd_id").alias("doc_id"), "digest")
