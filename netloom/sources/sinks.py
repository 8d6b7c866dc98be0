"""Writers of the text formats. A single ordered file is sorted by range and written part by part, in order.

`ordered_text` writes the parts of one folder; their names sort in the order of the lines, so `cat` joins them. `one_file`
gives a single part, for short files that other tools read; it brings all lines to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import cycle_expansion
from netloom.operators.hypergraph import Hypergraph, pin_degree


def ordered_text(lines: DataFrame, order: list[str], path: str, one_file: bool = False) -> None:
    """lines (line, order columns) as text in that order."""
    out = lines.orderBy(*order).select("line")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def hgr_lines(h: Hypergraph, shift: int = 0, edge_weights: bool = True, vertex_weights: bool = True) -> DataFrame:
    """(kind, id, line): header, one line a hyperedge, one a vertex. shift is added to vertex ids."""
    flag = (1 if edge_weights else 0) + (10 if vertex_weights else 0)
    n = h.hyperedges.agg(F.count("*").alias("m")).crossJoin(h.vertices.agg(F.count("*").alias("n")))
    head = n.select(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("id"), F.concat_ws(" ", "m", "n", *([F.lit(flag)] if flag else [])).alias("line"))
    lists = h.pins.groupBy("e").agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")), lambda v: (v + shift).cast("string")), " ").alias("p"))
    edges = h.hyperedges.join(lists, "e", "left").select(F.lit(1).alias("kind"), F.col("e").alias("id"), F.concat_ws(" ", *([F.col("hwt")] if edge_weights else []), "p").alias("line"))
    out = head.unionByName(edges)
    if vertex_weights:
        out = out.unionByName(h.vertices.select(F.lit(2).alias("kind"), F.col("v").alias("id"), F.col("vwt").cast("string").alias("line")))
    return out


def write_hgr(h: Hypergraph, path: str, shift: int = 0, edge_weights: bool = True, vertex_weights: bool = True) -> None:
    """path holds the .hgr text; path.fixed is written too if any vertex is fixed (-1 for free ones)."""
    ordered_text(hgr_lines(h, shift, edge_weights, vertex_weights), ["kind", "id"], path)
    if not h.vertices.where("fixed is not null").isEmpty():
        write_vector(h.vertices.select("v", F.col("fixed").alias("part")), f"{path}.fixed")


def write_vector(parts: DataFrame, path: str) -> None:
    """(v, part) as one integer a line in the order of v, null as -1."""
    ordered_text(parts.select("v", F.coalesce("part", F.lit(-1)).cast("string").alias("line")), ["v"], path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    ordered_text(clusters.select("v", F.concat_ws(",", "v", "cluster").alias("line")), ["v"], path)


def metis_lines(h: Hypergraph) -> DataFrame:
    """(id, line): `vertices edges 001`, then neighbour and weight pairs of each vertex, ids from the vertices' own."""
    arcs = cycle_expansion(h)
    adjacent = arcs.groupBy(F.col("src").alias("v")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", F.round("w").cast("bigint").alias("w")))), lambda x: F.concat_ws(" ", x["dst"], x["w"])), " ").alias("line"))
    n = h.vertices.agg(F.count("*").alias("n")).crossJoin(arcs.agg((F.count("*") / 2).cast("bigint").alias("m")))
    return n.select(F.lit(-1).cast("bigint").alias("id"), F.concat_ws(" ", "n", "m", F.lit("001")).alias("line")).unionByName(h.vertices.join(adjacent, "v", "left").select(F.col("v").alias("id"), F.coalesce("line", F.lit("")).alias("line")))


def write_metis(h: Hypergraph, path: str) -> None:
    ordered_text(metis_lines(h), ["id"], path)


def write_embedding_csv(x: DataFrame, parts: DataFrame, path: str) -> None:
    """x (v, x, y), parts (v, part): Eigen1,Eigen2,Partition."""
    x.join(parts, "v").orderBy("v").select(F.col("x").alias("Eigen1"), F.col("y").alias("Eigen2"), F.col("part").alias("Partition")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sample(h: Hypergraph, raw_pins: DataFrame, path: str, shift: int = -1) -> None:
    """path/nodes.txt (`id 1.0 degree`) and path/hedges.txt (`id; pins; 0`), ids from 0."""
    d = pin_degree(raw_pins, h.vertices)
    ordered_text(d.select("v", F.concat_ws(" ", F.col("v") + shift, F.lit("1.0"), "degree").alias("line")), ["v"], f"{path}/nodes.txt")
    p = raw_pins.groupBy("e").agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")), lambda v: (v + shift).cast("string")), " ").alias("p"))
    ordered_text(p.select("e", F.concat_ws("; ", F.col("e") + shift, "p", F.lit("0")).alias("line")), ["e"], f"{path}/hedges.txt")


def write_partitioned(rows: DataFrame, parts: DataFrame, path: str) -> None:
    """rows (v, ...) as Parquet in a folder for each part."""
    rows.join(parts, "v").write.mode("overwrite").partitionBy("part").parquet(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(json): one object of (pos, key, value) in order, repeated keys kept, numbers bare and special floats quoted."""
    number = F.col("value").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.col("value"), r'(["\\])', r"\\$1"), F.lit('"'))
    item = F.concat(F.lit('  "'), "key", F.lit('": '), F.when(finite, F.col("value")).otherwise(quoted))
    rows = metrics.select("pos", item.alias("i")).agg(F.array_sort(F.collect_list(F.struct("pos", "i"))).alias("r"))  # a report's few lines
    return rows.select(F.concat(F.lit("{\n"), F.array_join(F.col("r.i"), ",\n"), F.lit("\n}")).alias("json"))


def path_json(stages: DataFrame) -> DataFrame:
    """stages (path, pos, pin, x, y, arrival, slew) -> (path, json): one report a path."""
    p = F.struct("pos", "pin", "x", "y", "arrival", "slew")
    rows = stages.groupBy("path").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return rows.select("path", F.to_json(F.struct(F.transform("p", lambda s: F.struct(*[s[c].alias(c) for c in ("pin", "x", "y", "arrival", "slew")])).alias("path"))).alias("json"))


def def_components(components: DataFrame) -> DataFrame:
    """(inst, line): DEF component lines of (inst, master, status, x, y, orient)."""
    place = F.when(F.col("status").isNull() | (F.col("status") == "UNPLACED"), F.lit("+ UNPLACED")).otherwise(F.concat(F.lit("+ "), "status", F.lit(" ( "), "x", F.lit(" "), "y", F.lit(" ) "), "orient"))
    return components.select("inst", F.concat(F.lit("- "), "inst", F.lit(" "), "master", F.lit(" "), place, F.lit(" ;")).alias("line"))


def moved_components(components: DataFrame, placement: DataFrame, halo: int = 0) -> DataFrame:
    """Components with new places from placement (inst, nx, ny, macro); FIXED and unknown ones stay; macros shift by halo."""
    out = components.join(placement, "inst", "left")
    moves = F.col("nx").isNotNull() & ~F.col("status").eqNullSafe("FIXED")
    by = F.when(F.coalesce("macro", F.lit(False)), halo).otherwise(0)
    return out.select("inst", "master", F.when(moves, "PLACED").otherwise(F.col("status")).alias("status"), F.when(moves, F.col("nx") + by).otherwise(F.col("x")).alias("x"), F.when(moves, F.col("ny") + by).otherwise(F.col("y")).alias("y"), F.coalesce("orient", F.when(moves, "N")).alias("orient"))


def guide_lines(guides: DataFrame) -> DataFrame:
    """(net, line): the guide text of each net."""
    box = F.concat_ws(" ", "xlo", "ylo", "xhi", "yhi", "layer")
    rows = guides.groupBy("net").agg(F.array_join(F.sort_array(F.collect_list(box)), "\n").alias("b"))
    return rows.select("net", F.concat("net", F.lit("\n(\n"), "b", F.lit("\n)")).alias("line"))


def spice_lines(resistors: DataFrame, sources: DataFrame) -> DataFrame:
    """(pos, line): a SPICE grid of resistors (a, b, res) and sources (node, volt)."""
    from netloom.operators.ordered import row_numbers

    r = row_numbers(resistors, "a", "b").select((F.col("rn") * 2).alias("pos"), F.concat(F.lit("R"), "rn", F.lit(" "), "a", F.lit(" "), "b", F.lit(" "), "res").alias("line"))
    v = row_numbers(sources, "node").select((F.col("rn") * 2 + 1).alias("pos"), F.concat(F.lit("V"), "rn", F.lit(" "), "node", F.lit(" 0 "), "volt").alias("line"))
    return r.unionByName(v)


def verilog_lines(insts: DataFrame, pins: DataFrame, remove: list[str] | None = None) -> DataFrame:
    """insts (inst, master), pins (inst, term, net) -> (inst, line): one instance statement each, without removed masters."""
    p = pins.groupBy("inst").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("."), "term", F.lit("("), "net", F.lit(")")))), ", ").alias("p"))
    own = insts.where(~F.col("master").isin(remove)) if remove else insts
    return own.join(p, "inst", "left").select("inst", F.concat("master", F.lit(" "), "inst", F.lit(" ("), F.coalesce("p", F.lit("")), F.lit(");")).alias("line"))


def cdl_lines(insts: DataFrame, pins: DataFrame) -> DataFrame:
    """insts (inst, master), pins (inst, pos, net) -> (inst, line): X cards of a CDL netlist."""
    p = pins.groupBy("inst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "net"))), lambda s: s["net"]), " ").alias("p"))
    return insts.join(p, "inst", "left").select("inst", F.concat_ws(" ", F.concat(F.lit("X"), "inst"), "p", "master").alias("line"))


def blif_lines(model: str, inputs: DataFrame, outputs: DataFrame, gates: DataFrame) -> DataFrame:
    """(kind, id, line) of a BLIF model; gates (gate, cell, pins array of term=net)."""
    names = lambda df, kind, key: df.agg(F.concat_ws(" ", F.lit(key), F.array_join(F.sort_array(F.collect_list("name")), " ")).alias("line")).select(F.lit(kind).alias("kind"), F.lit("").alias("id"), "line")
    head = inputs.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit("").alias("id"), F.lit(f".model {model}").alias("line"))
    end = head.select(F.lit(4).alias("kind"), "id", F.lit(".end").alias("line"))
    g = gates.select(F.lit(3).alias("kind"), F.col("gate").cast("string").alias("id"), F.concat_ws(" ", F.lit(".gate"), "cell", F.array_join("pins", " ")).alias("line"))
    return head.unionByName(names(inputs, 1, ".inputs")).unionByName(names(outputs, 2, ".outputs")).unionByName(g).unionByName(end)


def spef_lines(caps: DataFrame, resistors: DataFrame) -> DataFrame:
    """(net, line): the D_NET block of each net, from caps (net, total, node, other, cap) and resistors (net, a, b, res)."""
    n = F.row_number
    from pyspark.sql import Window

    c = caps.withColumn("i", n().over(Window.partitionBy("net").orderBy("node", "other"))).withColumn("l", F.concat_ws(" ", "i", "node", "other", "cap"))
    c = c.groupBy("net").agg(F.max("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]), "\n").alias("caps"))
    r = resistors.withColumn("i", n().over(Window.partitionBy("net").orderBy("a", "b"))).withColumn("l", F.concat_ws(" ", "i", "a", "b", "res"))
    r = r.groupBy("net").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]), "\n").alias("res"))
    line = F.concat(F.lit("*D_NET "), "net", F.lit(" "), "total", F.lit("\n*CAP\n"), "caps", F.lit("\n*RES\n"), F.coalesce("res", F.lit("")), F.lit("\n*END"))
    return c.join(r, "net", "left").select("net", line.alias("line"))
