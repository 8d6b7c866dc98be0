"""Cut, gain, balance and connectivity of partitions (v, part) of a hypergraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.hypergraph import Hypergraph


def edge_parts(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """(e, lo, hi, size): one aggregation, in which lo <> hi says that e is cut without counting distinct parts."""
    return h.pins.join(parts, "v").groupBy("e").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size"))


def cut_edges(h: Hypergraph, parts: DataFrame) -> DataFrame:
    return edge_parts(h, parts).where("lo <> hi").select("e")


def edge_part(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """-1 for a cut hyperedge, else the part that holds all of it."""
    return edge_parts(h, parts).select("e", F.when(F.col("lo") != F.col("hi"), -1).otherwise(F.col("lo")).cast("int").alias("part"))


def nodes_in_cut_only(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """Vertices none of whose hyperedges is whole; isolated vertices count."""
    whole = edge_parts(h, parts).where("lo = hi").select("e")
    return h.vertices.select("v").join(h.pins.join(whole, "e", "left_semi"), "v", "left_anti")


def incident_cut_weight(h: Hypergraph, parts: DataFrame) -> DataFrame:
    cut = h.hyperedges.join(cut_edges(h, parts), "e", "left_semi")
    w = h.pins.join(cut, "e").groupBy("v").agg(F.sum("hwt").alias("w"))
    return h.vertices.join(w, "v", "left").select("v", F.coalesce("w", F.lit(0)).alias("cut_weight"))


def pins_by_part(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """(e, part, n, one): pins of each hyperedge in each part; one is a vertex of them."""
    return h.pins.join(parts, "v").groupBy("e", "part").agg(F.count("*").alias("n"), F.min("v").alias("one"))


def move_gain_free(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """For two parts: what a vertex frees by moving alone, the weight of its cut edges where it is alone on its side.

    A cut hyperedge of two pins credits both. Vertices that free nothing have 0.
    """
    alone = pins_by_part(h, parts).where("n = 1").select("e", F.col("one").alias("v"))
    alone = alone.join(cut_edges(h, parts), "e", "left_semi").join(h.hyperedges, "e")
    gain = alone.groupBy("v").agg(F.sum("hwt").alias("g"))
    return h.vertices.join(gain, "v", "left").select("v", F.coalesce("g", F.lit(0)).alias("gain"))


def kway_gain(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """(v, target, gain): change of the cut if v moves to a part that one of its hyperedges touches.

    + weight where v is alone in its part and all other pins are in the target, - weight where the hyperedge is whole.
    """
    count = pins_by_part(h, parts).select("e", "part", "n")
    size = count.groupBy("e").agg(F.sum("n").alias("size"))
    block = count.join(size, "e").join(h.hyperedges, "e")
    # gains and losses are worked out for (hyperedge, block), a few rows each, before any pin is joined
    other = count.select("e", F.col("part").alias("target"), F.col("n").alias("there"))
    frees = (F.col("n") == 1) & (F.col("there") == F.col("size") - 1)
    pairs = block.join(other, "e").where("target <> part").select("e", "part", "target", F.when(frees, F.col("hwt")).otherwise(0).alias("d"))
    whole = block.where("n = size and size > 1").select("e", "part", "hwt")
    at = h.pins.join(parts, "v")
    won = at.join(pairs, ["e", "part"]).groupBy("v", "target").agg(F.sum("d").alias("won"))
    lost = at.join(whole, ["e", "part"]).groupBy("v").agg(F.sum("hwt").alias("lost"))
    return won.join(lost, "v", "left").select("v", "target", (F.col("won") - F.coalesce("lost", F.lit(0))).alias("gain"))


def spread(h: Hypergraph, parts: DataFrame, *by: str) -> DataFrame:
    """(e, size, k, lo, hi): pins and touched parts of each hyperedge, with (part, n, one) of its least and its largest part: their pins
    and a vertex of them. The pins are dealt by hyperedge once. Columns `by` of parts, which tell solutions apart, stay."""
    count = h.pins.join(parts, "v").repartition("e").groupBy(*by, "e", "part").agg(F.count("*").alias("n"), F.min("v").alias("one"))
    block = F.struct("part", "n", "one")
    return count.groupBy(*by, "e").agg(F.sum("n").alias("size"), F.count("*").alias("k"), F.min(block).alias("lo"), F.max(block).alias("hi"))


def rising_moves(h: Hypergraph, spans: DataFrame, *by: str) -> DataFrame:
    """spans of `spread` -> (v, target, gain): the rows of `kway_gain` with a gain over 0, for each solution by itself.

    Only hyperedges of two parts with a vertex alone in one of them free anything, so what is won comes from a row a
    hyperedge, and pins are joined only for what is lost.
    """
    own = spans.join(h.hyperedges, "e")
    alone = lambda a, b: F.when(F.col(f"{a}.n") == 1, F.struct(F.col(f"{a}.one").alias("v"), F.col(f"{b}.part").alias("target")))
    moves = own.where("k = 2").select(*by, "hwt", F.explode(F.array_compact(F.array(alone("lo", "hi"), alone("hi", "lo")))).alias("m"))
    won = moves.groupBy(*by, "m.v", "m.target").agg(F.sum("hwt").alias("won")).where("won > 0")
    whole = own.where("k = 1 and size > 1").select(*by, "e", "hwt")
    lost = h.pins.join(whole, "e").groupBy(*by, "v").agg(F.sum("hwt").alias("lost"))
    gain = F.col("won") - F.coalesce("lost", F.lit(0))
    return won.join(lost, [*by, "v"], "left").select(*by, "v", "target", gain.alias("gain")).where("gain > 0")


def cut_size(h: Hypergraph, parts: DataFrame) -> DataFrame:
    cut = h.hyperedges.join(cut_edges(h, parts), "e", "left_semi")
    return cut.agg(F.coalesce(F.sum("hwt"), F.lit(0)).alias("cut"))


def connectivity(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """cut and the summed weight * (number of parts - 1), from one count of (e, part)."""
    spans = pins_by_part(h, parts).groupBy("e").agg(F.count("*").alias("spans")).join(h.hyperedges, "e")
    return spans.agg(
        F.coalesce(F.sum(F.when(F.col("spans") > 1, F.col("hwt")).otherwise(0)), F.lit(0)).alias("cut"),
        F.coalesce(F.sum(F.col("hwt") * (F.col("spans") - 1)), F.lit(0)).alias("connectivity"),
    )


def block_balance(h: Hypergraph, parts: DataFrame) -> DataFrame:
    """(part, weight, share): summed vertex weight of each block and its share of all."""
    w = h.vertices.join(parts, "v").groupBy("part").agg(F.sum("vwt").alias("weight"))
    return w.crossJoin(h.vertices.agg(F.sum("vwt").alias("all"))).select("part", "weight", F.round(F.col("weight") / F.col("all"), 6).alias("share"))


def evaluate(h: Hypergraph, parts: DataFrame, k: int, ub: float) -> DataFrame:
    """One row (cut, max_block, block_limit, feasible, reason).

    Infeasible are, in this order: a vertex without a part, a part below 0, a block over (100 / k + ub) percent of
    the weight. The limit is strict, the cut is given anyway.
    """
    total = h.vertices.agg(F.sum("vwt").alias("all"), F.count("*").alias("n"))
    joined = h.vertices.join(parts, "v", "left")
    state = joined.agg(F.count_if(F.col("part").isNull()).alias("missing"), F.count_if(F.col("part") < 0).alias("free"))
    most = joined.groupBy("part").agg(F.sum("vwt").alias("w")).agg(F.max("w").alias("max_block"))
    one = total.crossJoin(state).crossJoin(most).crossJoin(cut_size(h, parts))  # four rows in all
    limit = (100 / k + ub) * 0.01 * F.col("all")
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("missing") > 0, "length").when(F.col("free") > 0, "unassigned").when(F.col("max_block") > limit, "balance")
    return one.select("cut", "max_block", F.round(limit, 6).alias("block_limit"), reason.isNull().alias("feasible"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def legacy_cost(evaluated: DataFrame) -> DataFrame:
    """The compatible form: cost 1e9 for anything infeasible."""
    return evaluated.select(F.when(F.col("feasible"), F.col("cut").cast("double")).otherwise(F.lit(1e9)).alias("cost"))


def cut_hits(h: Hypergraph, solutions: list[DataFrame]) -> DataFrame:
    """(e, hits): in how many of the solutions a hyperedge is cut, for those cut in any."""
    every = None
    for parts in solutions:
        cut = cut_edges(h, parts)
        every = cut if every is None else every.unionAll(cut)
    return every.groupBy("e").agg(F.count("*").alias("hits"))


def net_reweight(h: Hypergraph, clusters: DataFrame, same_sub: float = 1.2, same: float = 1.0, other: float = 0.8) -> DataFrame:
    """clusters (v, cluster, sub): a factor by whether all pins share the sub-cluster, the cluster, or neither."""
    at = h.pins.join(clusters, "v").groupBy("e").agg(*[f(c).alias(f"{n}_{c}") for c in ("cluster", "sub") for n, f in (("lo", F.min), ("hi", F.max))])
    whole = F.col("lo_cluster") == F.col("hi_cluster")
    factor = F.when(whole & (F.col("lo_sub") == F.col("hi_sub")), same_sub).when(whole, same).otherwise(other)
    return at.join(h.hyperedges, "e").select("e", F.round(F.col("hwt") * factor, 6).alias("weight"))


#: solutions that one pass over the pins scores
BESIDE = 32


def best_of(h: Hypergraph, solutions: DataFrame, keep: int) -> DataFrame:
    """solutions (solution, v, part) -> (solution, cut): the keep ones of the least cut, ties by solution.

    A vertex's parts of BESIDE solutions stand in one row, so a pin is one row whatever their number, and a pass over
    the pins scores them all. Only the names of the solutions come to the driver.
    """
    names = sorted(r.solution for r in solutions.select("solution").distinct().collect())
    cut = None
    for i in range(0, len(names), BESIDE):
        some = names[i : i + BESIDE]
        own = [F.max(F.when(F.col("solution") == s, F.col("part"))).alias(f"p{j}") for j, s in enumerate(some)]
        parts = solutions.where(F.col("solution").isin(some)).groupBy("v").agg(*own)
        at = h.pins.join(parts.hint("merge"), "v").drop("v").repartition("e")  # the rows are too many to broadcast
        spans = at.groupBy("e").agg(*[(F.min(f"p{j}") != F.max(f"p{j}")).alias(f"p{j}") for j in range(len(some))]).join(h.hyperedges, "e")
        sums = spans.agg(*[F.coalesce(F.sum(F.when(F.col(f"p{j}"), F.col("hwt"))), F.lit(0)).alias(f"p{j}") for j in range(len(some))])
        each = sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("solution"), F.col(f"p{j}").alias("cut")) for j, s in enumerate(some)])).alias("s")).select("s.*")
        cut = each if cut is None else cut.unionByName(each)
    cut = cut if cut is not None else solutions.select("solution", F.lit(0).cast("bigint").alias("cut")).limit(0)
    kind = solutions.schema["solution"].dataType
    return cut.select(F.col("solution").cast(kind).alias("solution"), "cut").orderBy("cut", "solution").limit(keep)
