"""The hypergraph model and its degree, incidence and hash operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordered import prefix_sum


@dataclass(frozen=True)
class Hypergraph:
    """vertices (v, vwt, fixed), hyperedges (e, hwt) and pins (e, v), all lazy. fixed is the block or null."""

    vertices: DataFrame
    hyperedges: DataFrame
    pins: DataFrame

    def validate(self) -> Hypergraph:
        """Raises if a pin names an unknown vertex or hyperedge."""
        for table, key in ((self.vertices, "v"), (self.hyperedges, "e")):
            if not self.pins.join(table, key, "left_anti").isEmpty():
                raise ValueError(f"pins name an unknown {key}")
        return self

    def sizes(self) -> DataFrame:
        return self.pins.groupBy("e").agg(F.count("*").alias("size"))


def pin_degree(raw_pins: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pins of each vertex with repeats; 0 where there is none."""
    n = raw_pins.groupBy("v").agg(F.count("*").alias("n"))
    return vertices.join(n, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("degree"))


def weighted_degree(h: Hypergraph) -> DataFrame:
    """Summed weight of the hyperedges at each vertex; a vertex repeated in a hyperedge counts once."""
    d = h.pins.distinct().join(h.hyperedges, "e").groupBy("v").agg(F.sum("hwt").alias("d"))
    return h.vertices.join(d, "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("degree"))


def incidence_list(h: Hypergraph) -> DataFrame:
    """Sorted hyperedges of each vertex, an empty array for isolated ones."""
    lists = h.pins.groupBy("v").agg(F.sort_array(F.collect_set("e")).alias("edges"))
    return h.vertices.join(lists, "v", "left").select("v", F.coalesce("edges", F.array().cast("array<bigint>")).alias("edges"))


def pair_list(h: Hypergraph) -> DataFrame:
    """Inclusive 1-based [first, last] pin places of each hyperedge when pins are laid out in the order of e."""
    run = prefix_sum(h.sizes(), "e", "size")
    return run.select("e", (F.col("total") - F.col("size") + 1).alias("first"), F.col("total").alias("last"))


def hyperedge_hash(h: Hypergraph) -> DataFrame:
    """Sum of squared vertex ids: equal hyperedges have equal values."""
    return h.pins.groupBy("e").agg(F.sum(F.col("v") * F.col("v")).alias("hash"))


def max_fanout(h: Hypergraph, most: int) -> Hypergraph:
    """Without the hyperedges of more than `most` pins; filter before any self-join of pins."""
    keep = h.sizes().where(F.col("size") <= most).select("e")
    return Hypergraph(h.vertices, h.hyperedges.join(keep, "e", "left_semi"), h.pins.join(keep, "e", "left_semi"))


def fanout_histogram(h: Hypergraph) -> DataFrame:
    return h.sizes().groupBy("size").agg(F.count("*").alias("n_edges"))


def hyperstretch(h: Hypergraph, coords: DataFrame) -> DataFrame:
    """Root of the summed squares, over x and y, of the summed distances of an edge's pins from their mean."""
    at = h.pins.join(coords, "v")
    mean = at.groupBy("e").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = at.join(mean, "e").groupBy("e").agg(F.sum(F.abs(F.col("x") - F.col("mx"))).alias("dx"), F.sum(F.abs(F.col("y") - F.col("my"))).alias("dy"))
    return d.select("e", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("stretch"))
