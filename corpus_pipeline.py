"""A corpus pipeline of five stages over the documents table; part of the subpackage netloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. Rows that share a doc_id or have none are
documents of their own if their texts differ; no row goes because of its id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, decontam, quality, substrings
from netloom.llm.minhash import NearDedup, near_duplicates
from netloom.llm.store import columns_of, table, with_key


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier learns from the labelled rows outside the held-out third.

    Rows are judged one by one; null and empty texts are judged by the model's bias.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(spark, docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return quality.keep(spark, docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id (null last, then by digest).

    Of rows that are equal in doc_id and text the least by the other columns stays. Null, empty and blank texts are near
    nothing and all stay, unless they repeat an id.
    """
    keyed, odd = with_key(spark, docs)
    found = near_duplicates(spark, keyed.select(F.col("key").alias("doc_id"), "row.text"), NearDedup())
    if odd is None:
        kept = found.where("kept").select(F.col("doc_id").alias("key"))
        return keyed.join(kept, "key", "left_semi").select("row.*")
    named = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(odd, "key", "left")
    own_id = F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("doc_id").cast("long"))
    best = F.min(F.struct(own_id.isNull().alias("none"), own_id.alias("id"), "digest", "key"))
    kept = table(spark, named.groupBy("component_id").agg(best.alias("b")).select("b.key"), "kept")
    rows = keyed.join(kept, "key", "left_semi")
    many = rows.join(odd.select("key"), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    single = rows.join(odd.select("key"), "key", "left_anti")
    return single.select("row.*").unionAll(many.select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand anywhere else are cut out of the texts; n_chars follows.

    Null texts become empty. Every row stays.
    """
    # the text goes through by itself, all else as one struct, so that no column's name matters
    rest = F.struct(*[c for name, c in zip(docs.columns, columns_of(docs), strict=True) if name != "text"]).alias("rest")
    out = substrings.remove_repeats(spark, docs.select("doc_id", "text", rest), words=50, carry=("rest",))
    put = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[put.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edit budget, go; others of the same or no doc_id stay."""
    keyed, _ = with_key(spark, docs)
    found = decontam.contaminated(spark, keyed.select(F.col("key").alias("doc_id"), "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = table(spark, found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return keyed.join(leaks, "key", "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of what they decode to; a null text is empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.tokenize(spark, docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: no stage but the last can be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
