"""Named queries on the star-schema tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from netloom.operators.hypergraph import Hypergraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one scale factor and the hypergraph read from them.

    hyperedge = order, vertex = part, pins = distinct (order, part), vertex weight = part size, edge weight = line
    count, coordinates x = v % 100, y = v // 100.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw_pins(self) -> DataFrame:
        return self.lineitem.selectExpr("l_orderkey e", "l_partkey v")

    @cached_property
    def h(self) -> Hypergraph:
        vertices = self.part.selectExpr("p_partkey v", "cast(p_size as bigint) vwt", "if(p_partkey < 10, cast(p_partkey % 2 as int), null) fixed")
        edges = self.lineitem.groupBy("l_orderkey").count().selectExpr("l_orderkey e", "`count` hwt")
        return Hypergraph(vertices, edges, self.raw_pins.distinct())

    def parts(self, k: int = 2, shift: int = 1) -> DataFrame:
        return self.part.selectExpr("p_partkey v", f"cast((p_partkey div {shift}) % {k} as int) part")

    @cached_property
    def coords(self) -> DataFrame:
        return self.part.selectExpr("p_partkey v", "p_partkey % 100 x", "p_partkey div 100 y")

    @cached_property
    def boxes(self) -> DataFrame:
        return self.coords.join(self.part.selectExpr("p_partkey v", "cast(p_size as bigint) s"), "v").selectExpr("v", "x xlo", "y ylo", "x + s % 7 + 1 xhi", "y + s % 5 + 1 yhi")


#: the same objects in SQL
SQL = """WITH RECURSIVE pins AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem),
 vertices AS (SELECT p_partkey AS v, p_size::BIGINT AS vwt, CASE WHEN p_partkey < 10 THEN (p_partkey % 2)::INT END AS fixed FROM part),
 hyperedges AS (SELECT l_orderkey AS e, count(*)::BIGINT AS hwt FROM lineitem GROUP BY 1),
 parts2 AS (SELECT p_partkey AS v, (p_partkey % 2)::INT AS part FROM part),
 parts4 AS (SELECT p_partkey AS v, (p_partkey % 4)::INT AS part FROM part),
 other2 AS (SELECT p_partkey AS v, ((p_partkey // 3) % 2)::INT AS part FROM part),
 coords AS (SELECT p_partkey AS v, p_partkey % 100 AS x, p_partkey // 100 AS y FROM part),
 boxes AS (SELECT p_partkey AS v, p_partkey % 100 AS xlo, p_partkey // 100 AS ylo, p_partkey % 100 + p_size % 7 + 1 AS xhi, p_partkey // 100 + p_size % 5 + 1 AS yhi FROM part),
 epart AS (SELECT e, min(part) AS lo, max(part) AS hi, count(*)::BIGINT AS size, count(DISTINCT part)::BIGINT AS spans FROM pins JOIN parts2 USING (v) GROUP BY e),
 epart4 AS (SELECT e, min(part) AS lo, max(part) AS hi, count(DISTINCT part)::BIGINT AS spans FROM pins JOIN parts4 USING (v) GROUP BY e)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its own name; sql without WITH gets the common definitions in front."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLE[key] = SQL + ("," + text[4:] if text.startswith("AND ") else text)
        return f

    return add
