"""Round trips through the text formats: written to the shared folder, read back, compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordered import row_numbers
from netloom.plans.registry import query
from netloom.session import cut_lineage, shared_dir
from netloom.sources import sinks, text


def _place(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/netloom/{uuid.uuid4().hex}/{name}"


def _renumbered(t):
    """The hypergraph with ids from 1 without gaps, as the .hgr format has them."""
    edges = row_numbers(t.h.hyperedges, "e", name="n")
    pins = t.h.pins.join(edges.select("e", "n"), "e").selectExpr("n e", "v + 1 v")
    return type(t.h)(t.h.vertices.selectExpr("v + 1 v", "vwt", "fixed"), edges.selectExpr("n e", "hwt"), pins)


def _lines(t, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df (line, order columns) written in that order and read back with places from 0."""
    path = _place(t, name)
    sinks.ordered_text(df, order, path)
    return text.all_lines(t.spark, path).where("line <> ''").select(F.col("pos").cast("bigint").alias("pos"), "line")


@query("AND n AS (SELECT e, row_number() OVER (ORDER BY e) AS n, hwt FROM hyperedges) SELECT n.n AS e, hwt, v + 1 AS v, vwt FROM pins JOIN n USING (e) JOIN vertices USING (v)")
def hgr_round_trip(t):
    path = _place(t, "h.hgr")
    sinks.write_hgr(_renumbered(t), path)
    h = text.read_hgr(t.spark, path)
    return h.pins.join(h.hyperedges, "e").join(h.vertices, "v").select("e", "hwt", "v", "vwt")


@query("SELECT p_partkey + 1 AS v, CASE WHEN p_partkey < 10 THEN (p_partkey % 2)::INT END AS part FROM part")
def vector_round_trip(t):
    """.fix and .part.K: one integer a line, -1 for none."""
    path = _place(t, "h.fix")
    sinks.write_vector(t.h.vertices.select("v", F.col("fixed").alias("part")), path)
    return text.read_vector(t.spark, path)


@query("SELECT p_partkey AS pos, p_partkey || ',' || p_partkey % 4 AS line FROM part")
def clusters_file(t):
    path = _place(t, "clusters.dat")
    sinks.write_clusters(t.parts(4).withColumnRenamed("part", "cluster"), path)
    return text.all_lines(t.spark, path).where("line <> ''").select(F.col("pos").cast("bigint").alias("pos"), "line")


@query("""AND p AS (SELECT e, v, count(*) OVER (PARTITION BY e) AS k, coalesce(lead(v) OVER (PARTITION BY e ORDER BY v), min(v) OVER (PARTITION BY e)) AS nxt FROM pins),
 a AS (SELECT v AS src, nxt AS dst, CASE k WHEN 2 THEN hwt::DOUBLE WHEN 3 THEN hwt / 2 ELSE hwt / (2 * (floor(k / 2) * ceil(k / 2) / (k - 1))) END AS w FROM p JOIN hyperedges USING (e) WHERE k > 2 OR (k = 2 AND v < nxt)),
 s AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a), d AS (SELECT src, count(*) AS n, list(dst ORDER BY dst) AS near FROM s GROUP BY src)
 SELECT v, coalesce(n, 0)::BIGINT AS neighbours, coalesce(near, []) AS near FROM vertices LEFT JOIN d ON src = v""")
def metis_file(t):
    """The adjacency lines, read as neighbour and weight pairs."""
    from netloom.sources.sinks import metis_lines

    own = _lines(t, metis_lines(t.h).withColumn("line", F.concat(F.lit("|"), "line")), ["id"], "g.gr").where("pos > 0")
    words = F.filter(F.split(F.substring("line", 2, 1 << 30), " "), lambda x: x != "")
    near = F.transform(F.filter(words, lambda x, i: i % 2 == 0), lambda x: x.cast("bigint"))
    return own.select((F.col("pos") - 1).alias("v"), F.size(near).cast("bigint").alias("neighbours"), near.alias("near"))


@query("""AND d AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_partkey AS pos, p_partkey || ' 1.0 ' || coalesce(n, 0) AS line FROM part LEFT JOIN d ON v = p_partkey""")
def sample_nodes(t):
    path = _place(t, "sample")
    sinks.write_sample(t.h, t.raw_pins, path, shift=0)
    return text.all_lines(t.spark, f"{path}/nodes.txt").where("line <> ''").select(F.col("pos").cast("bigint").alias("pos"), "line")


@query("SELECT p_partkey AS inst, 'M' || p_size AS master, 'FIXED' AS status, p_partkey % 100 AS x, p_partkey // 100 AS y, 'N' AS orient FROM part")
def def_components_round_trip(t):
    own = t.coords.join(t.part.selectExpr("p_partkey v", "concat('M', p_size) master"), "v")
    lines = sinks.def_components(own.selectExpr("cast(v as string) inst", "master", "'FIXED' status", "x", "y", "'N' orient")).select("line", F.col("inst").cast("bigint").alias("o"))
    head = t.spark.createDataFrame([("COMPONENTS 1 ;", -1), ("END COMPONENTS", 1 << 60)], "line string, o long")
    path = _place(t, "d.def")
    sinks.ordered_text(lines.unionByName(head), ["o"], path)
    c = text.read_def(t.spark, path, ("COMPONENTS",))["COMPONENTS"]
    return c.select(F.col("inst").cast("bigint").alias("inst"), "master", "status", "x", "y", "orient")


@query("SELECT user_id::VARCHAR AS id, epoch_us(ts) AS t, (value > 0.5)::INT::VARCHAR AS value FROM events")
def vcd_read(t):
    """Value changes written as a waveform file and read back."""
    e = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") > 0.5).cast("int").alias("b"))
    names = e.select("user_id").distinct().select(F.lit(-2).cast("bigint").alias("t"), F.lit(0).alias("k"), F.concat(F.lit("$var wire 1 "), "user_id", F.lit(" n"), "user_id", F.lit(" $end")).alias("line"))
    end = t.spark.createDataFrame([(-1, 0, "$enddefinitions $end")], "t long, k int, line string")
    times = e.select("t").distinct().select("t", F.lit(0).alias("k"), F.concat(F.lit("#"), "t").alias("line"))
    rows = e.select("t", F.lit(1).alias("k"), F.concat("b", "user_id").alias("line"))
    path = _place(t, "w.vcd")
    sinks.ordered_text(cut_lineage(names.unionByName(end).unionByName(times).unionByName(rows)), ["t", "k"], path)
    return text.read_vcd(t.spark, path).select("id", "t", "value")
