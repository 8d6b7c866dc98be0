"""Mixing of sources to target weights: hash-random keys, ranges inside each source, distributed prefix sums.

Each document gets a key from a hash of a seed, its doc_id and its text, so its place in the random order of its source
doesn't depend on partitions or reruns. Keys are even, so equal cuts of their span deal a source's documents to ranges
of about RANGE_ROWS rows; a source that holds most rows is many ranges. Rows are sorted and summed inside a range; the
ranges' totals, at most MAX_RANGES a source, are summed in their order and joined back. A source whose target is q
whole passes and r words more gives every document q times and the first r words of its order once more: the document
at the cut is taken in part, so that the target is met to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.store import drop, table

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 1000
MAX_RANGES = 20_000
#: per-source rows up to this many are broadcast, more are joined by shuffle
BROADCAST_SOURCES = 50_000
_KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str) -> Column:
    """60 bits of MD5 over seed, doc_id and the text's MD5; null doc_id and text count as empty."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def sized(spark: SparkSession, docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, text) -> (doc_id, source, size, key, n): n equal rows each, written as a table."""
    own = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(seed).alias("key"))
    return table(spark, own.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "sized")


def source_sizes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(source, source_size, documents), a row for each source, null included; written as a table."""
    return table(spark, rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")), "sources")


def cycled_weights(spark: SparkSession, sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds `weight`: the sources by code point, null last, take the weights in turn."""
    n, i = len(weights), F.spark_partition_id()
    parts = max(1, -(-sources.count() // 100_000))
    # ranges of names follow each other; a row for each range gives the number of names before it
    own = table(spark, sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", i), "named")
    before = own.groupBy("part").agg(F.count("*").alias("c")).select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    return own.join(F.broadcast(before), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int"))).drop("part", "before")


def targets(spark: SparkSession, sources: DataFrame, total: int, epochs: int) -> DataFrame:
    """Adds `target` to sources (source, source_size, weight): shares of total by weight, at most `epochs` times the
    source's size; what is over is shared by the others' weights until no target is above.

    The share of one unit of weight only rises from round to round, so sources that are at their bound stay there. A
    round sums up the sources; none of them comes to the driver. A total above epochs times all sizes, or without any
    positive weight, leaves the rest unshared. Weights below 1 and null ones are 0.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("long"), F.lit(0)), F.lit(0))
    own = table(spark, sources.withColumn("weight", weight).withColumn("most", F.lit(epochs) * F.col("source_size")), "weighted")
    left, units = total, own.agg(F.sum("weight")).first()[0] or 0
    while units:
        full = F.col("most").cast("double") * units <= F.col("weight").cast("double") * left
        row = own.agg(F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("units")).first()
        new = (total - (row.most or 0), row.units or 0)
        if new == (left, units):
            break
        left, units = new
    if not units:
        return own.withColumn("target", F.when(F.col("weight") > 0, F.col("most")).otherwise(0).cast("double")).drop("most")
    share = (F.col("weight").cast("double") * F.lit(left).cast("double")) / F.lit(units).cast("double")
    return own.withColumn("target", F.least(share, F.col("most").cast("double"))).drop("most")


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame | tuple[int, ...], total: int | None = None, epochs: int = 3, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, text) -> (doc_id, source, size, source_size, weight, target, taken), a row for each row.

    weights: a table (source, weight) of unique sources, where those not named weigh 0, or weights in turn for the
    sources by code point, null last. total: words of the mix; None: those of all documents. size counts the words of a text, 0 if null or
    empty; taken counts the words that the mix has of the row, repeats included: the whole document in each whole pass
    and what falls before the cut in the last. It is at most epochs * size, and a source's sum is its target rounded down.
    Rows of a null source are a source of their own. Rows that repeat doc_id, source and text are rows of their own
    that stand side by side in the order. An empty table gives no rows; further columns are ignored.
    """
    rows = sized(spark, docs, seed)
    sources = source_sizes(spark, rows)
    if isinstance(weights, tuple):
        weighted = cycled_weights(spark, sources, weights)
    else:
        named = weights.select(F.col("source").alias("named"), "weight")
        weighted = sources.join(named, F.expr("source <=> named"), "left").drop("named")
    if total is None:
        total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal = targets(spark, weighted, total, epochs)
    ranges = F.least(F.ceil(F.col("documents") / RANGE_ROWS), F.lit(MAX_RANGES)).cast("long")
    goal = goal.select(F.col("source").alias("own_source"), "source_size", "weight", "target", ranges.alias("ranges"))
    goal = table(spark, goal.withColumn("number", F.monotonically_increasing_id()), "targets")
    small = goal.count() <= BROADCAST_SOURCES
    half = _KEY_BITS // 2
    place = F.shiftright(F.shiftright("key", half) * F.col("ranges"), half).cast("int")
    placed = rows.join(F.broadcast(goal) if small else goal, F.expr("source <=> own_source")).withColumn("range", place)
    placed = table(spark, placed.select("doc_id", "size", "key", "n", "number", "range"), "placed")

    sums = placed.groupBy("number", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    upto = F.sum("words").over(Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    before = table(spark, sums.select("number", "range", (upto - F.col("words")).alias("before")), "before")
    inner = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("number", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    ordered = placed.withColumn("start", inner - F.col("size") * F.col("n")).join(before, ["number", "range"]).withColumn("start", F.col("start") + F.col("before"))
    ordered = ordered.join(F.broadcast(goal) if small else goal, "number")
    # equal rows stand side by side: the k-th of them begins k sizes later
    ordered = ordered.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    words = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    passes = passes - F.when(passes * F.col("source_size") > words, 1).otherwise(0)
    rest = words - passes * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("k") * F.col("size")))
    out = ordered.select("doc_id", F.col("own_source").alias("source"), "size", "source_size", "weight", "target", (passes * F.col("size") + last).cast("long").alias("taken"))
    out = table(spark, out, "mix")
    drop(rows, sources, placed, before)
    return out


def repeat_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed corpus: docs (doc_id, text) and a plan of `mix` -> (doc_id, epoch, text), a row for each time taken.

    The last one is cut behind as many words as the plan takes of it; other texts stay as they are. Each doc_id must be in one row of docs.
    """
    own = plan.where("taken > 0").select("doc_id", "size", "taken")
    each = own.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")).cast("long"))))
    rows = docs.select("doc_id", "text").join(each, "doc_id")
    part = F.col("taken") - F.col("epoch") * F.col("size")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, part.cast("int")), " ")
    return rows.select("doc_id", "epoch", F.when(part >= F.col("size"), F.col("text")).otherwise(words).alias("text"))
