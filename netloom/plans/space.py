"""Placement queries: wirelength, boxes, grids, density, congestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import spatial
from netloom.operators.hypergraph import max_fanout
from netloom.plans.registry import query
from netloom.session import cut_lineage, dealt

_NET = "net AS (SELECT e, max(x) - min(x) + max(y) - min(y) AS hpwl, min(x) AS xlo, min(y) AS ylo, max(x) + 1 AS xhi, max(y) + 1 AS yhi FROM pins JOIN coords USING (v) GROUP BY e)"


@query(f"AND {_NET} SELECT e, hpwl FROM net")
def hpwl_per_net(t):
    return spatial.hpwl(t.h.pins, t.coords)


@query(f"AND {_NET} SELECT sum(hpwl)::BIGINT AS hpwl FROM net")
def hpwl_total(t):
    return spatial.hpwl(t.h.pins, t.coords).agg(F.sum("hpwl").alias("hpwl"))


@query("""AND a AS (SELECT e, v, x, y FROM pins JOIN coords USING (v)), m AS (SELECT v, (v * 3) % 100 AS nx, (v * 5) % 20 AS ny FROM vertices),
 b AS (SELECT a.e, m.v AS mv, max(a.x) - min(a.x) + max(a.y) - min(a.y) AS old, max(CASE WHEN a.v = m.v THEN nx ELSE a.x END) - min(CASE WHEN a.v = m.v THEN nx ELSE a.x END)
  + max(CASE WHEN a.v = m.v THEN ny ELSE a.y END) - min(CASE WHEN a.v = m.v THEN ny ELSE a.y END) AS new FROM m JOIN pins p ON p.v = m.v JOIN a ON a.e = p.e GROUP BY a.e, m.v)
 SELECT mv AS v, sum(new - old)::BIGINT AS delta FROM b GROUP BY mv""")
def hpwl_move_delta(t):
    moves = t.h.vertices.selectExpr("v", "(v * 3) % 100 nx", "(v * 5) % 20 ny")
    return spatial.hpwl_move_delta(t.h.pins, t.coords, moves)


@query("SELECT sum(abs(x - (v * 3) % 100) + abs(y - (v * 5) % 20))::BIGINT AS total, round(avg(abs(x - (v * 3) % 100) + abs(y - (v * 5) % 20)), 6) AS average, max(abs(x - (v * 3) % 100) + abs(y - (v * 5) % 20)) AS most FROM coords")
def displacement_stats(t):
    return spatial.displacement(t.coords, t.coords.selectExpr("v", "(v * 3) % 100 x", "(v * 5) % 20 y"))


@query("SELECT v, least(greatest(floor((x - 5) / 10)::BIGINT, 0), 7) AS gx, least(greatest(floor((y - 2) / 4)::BIGINT, 0), 7) AS gy FROM coords")
def grid_index(t):
    return t.coords.select("v", spatial.grid_index(F.col("x"), 5, 10, 8).alias("gx"), spatial.grid_index(F.col("y"), 2, 4, 8).alias("gy"))


@query("SELECT n_nationkey::BIGINT AS axis, (n_nationkey * 10 + i * 7)::BIGINT AS line FROM nation, range(5) r(i)")
def grid_lines(t):
    return spatial.grid_lines(t.nation.selectExpr("cast(n_nationkey as bigint) axis", "cast(n_nationkey * 10 as bigint) origin", "5L n", "7L step"))


@query("SELECT v, 50 BETWEEN xlo - 2 AND xhi + 2 AND 10 BETWEEN ylo - 2 AND yhi + 2 AS inside FROM boxes")
def box_contains(t):
    return t.boxes.select("v", spatial.contains(F.lit(50), F.lit(10), 2).alias("inside"))


@query("""SELECT a.v AS a, b.v AS b, (least(a.xhi, b.xhi) - greatest(a.xlo, b.xlo)) * (least(a.yhi, b.yhi) - greatest(a.ylo, b.ylo)) AS area FROM boxes a JOIN boxes b
 ON a.v < b.v AND a.xlo < b.xhi AND b.xlo < a.xhi AND a.ylo < b.yhi AND b.ylo < a.yhi""")
def box_overlap_join(t):
    return spatial.overlaps(t.boxes, 8)


_TILE = """t AS (SELECT {key}, tx, ty, (least({x1}, (tx + 1) * 10) - greatest({x0}, tx * 10)) * (least({y1}, (ty + 1) * 10) - greatest({y0}, ty * 10)) AS area, {value} AS value, ({x1} - {x0}) * ({y1} - {y0}) AS whole
 FROM {src}, range(0, 12) a(tx), range(0, {rows}) b(ty) WHERE tx BETWEEN {x0} // 10 AND ({x1} - 1) // 10 AND ty BETWEEN {y0} // 10 AND ({y1} - 1) // 10)"""
_BOX = {"x0": "xlo", "x1": "xhi", "y0": "ylo", "y1": "yhi"}


@query(f"AND {_NET}, {_TILE.format(key='e', value='(xhi - xlo + yhi - ylo)::DOUBLE', src='net', rows=30, **_BOX)} SELECT tx, ty, round(sum(value * area / whole), 4) AS rudy FROM t GROUP BY tx, ty")
def rudy_map(t):
    return spatial.rudy(t.h.pins, t.coords, 10)


@query(f"AND {_TILE.format(key='v', value='1', src='boxes', rows=30, **_BOX)} SELECT tx, ty, sum(area)::BIGINT AS used, round(sum(area) / 100, 6) AS density FROM t GROUP BY tx, ty")
def density_map(t):
    return spatial.density(t.boxes, 10)


@query("AND d AS (SELECT DISTINCT x // 10 AS tx, y // 10 AS ty, e FROM pins JOIN coords USING (v)) SELECT tx, ty, count(*)::BIGINT AS usage, list(e ORDER BY e) AS nets FROM d GROUP BY tx, ty HAVING count(*) > 40")
def nets_per_tile(t):
    d = t.h.pins.join(t.coords, "v").select(F.expr("x div 10").alias("tx"), F.expr("y div 10").alias("ty"), "e").distinct()
    return d.groupBy("tx", "ty").agg(F.count("*").alias("usage"), F.sort_array(F.collect_list("e")).alias("nets")).where("usage > 40")


_USE = "u AS (SELECT 'metal' || (l_linenumber % 4) AS layer, sum(l_quantity)::BIGINT AS demand, sum(CASE WHEN l_linenumber % 4 = 1 THEN 20 ELSE 30 END)::BIGINT AS resource FROM lineitem GROUP BY 1)"


@query(f"""AND {_USE}, a AS (SELECT layer, demand, resource FROM u UNION ALL SELECT 'Total', sum(demand), sum(resource) FROM u)
 SELECT layer, resource::BIGINT AS resource, demand::BIGINT AS demand, round(100 * demand / resource::DOUBLE, 4) AS usage, greatest(demand - resource, 0)::BIGINT AS overflow FROM a""")
def congestion_report(t):
    own = t.lineitem.select(F.concat(F.lit("metal"), F.col("l_linenumber") % 4).alias("layer"), F.col("l_quantity").cast("bigint").alias("d"), F.when(F.col("l_linenumber") % 4 == 1, 20).otherwise(30).alias("r"))
    a = own.rollup("layer").agg(F.sum("r").alias("resource"), F.sum("d").alias("demand"), F.grouping("layer").alias("g"))
    usage = F.round(F.try_divide(100 * F.col("demand"), F.col("resource")), 4)
    return a.select(F.when(F.col("g") == 1, "Total").otherwise(F.col("layer")).alias("layer"), "resource", "demand", usage.alias("usage"), F.greatest(F.col("demand") - F.col("resource"), F.lit(0)).alias("overflow"))


@query("SELECT 'metal' || (l_linenumber % 4) AS layer, sum(20)::BIGINT AS original, sum(CASE WHEN l_quantity > 25 THEN 14 ELSE 20 END)::BIGINT AS derated, round(100 * (1 - sum(CASE WHEN l_quantity > 25 THEN 14 ELSE 20 END) / sum(20)::DOUBLE), 4) AS reduction FROM lineitem GROUP BY 1")
def resource_reduction(t):
    own = t.lineitem.groupBy(F.concat(F.lit("metal"), F.col("l_linenumber") % 4).alias("layer")).agg(F.sum(F.lit(20)).alias("original"), F.sum(F.when(F.col("l_quantity") > 25, 14).otherwise(20)).alias("derated"))
    return own.select("*", F.round(100 * (1 - F.try_divide("derated", "original")), 4).alias("reduction"))


@query("AND c AS (SELECT e, count(DISTINCT x // 50 * 1000 + y // 10) AS n FROM pins JOIN coords USING (v) GROUP BY e) SELECT e, n = 1 AS local FROM c")
def net_is_local(t):
    cell = F.expr("x div 50 * 1000 + y div 10")
    return t.h.pins.join(t.coords, "v").groupBy("e").agg((F.min(cell) == F.max(cell)).alias("local"))


@query("AND p AS (SELECT e, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pins JOIN coords USING (v) WINDOW w AS (PARTITION BY e ORDER BY v)) SELECT e, coalesce(sum(abs(nx - x) + abs(ny - y)), 0)::BIGINT AS length FROM p GROUP BY e")
def wire_length(t):
    from pyspark.sql import Window

    w = Window.partitionBy("e").orderBy("v")
    p = t.h.pins.join(t.coords, "v").select("e", (F.abs(F.lead("x").over(w) - F.col("x")) + F.abs(F.lead("y").over(w) - F.col("y"))).alias("d"))
    return p.groupBy("e").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("length"))


@query("SELECT count(*)::BIGINT AS cells, sum((xhi - xlo) * (yhi - ylo))::BIGINT AS area, ceil(sqrt(count(*)))::BIGINT AS ideal_bins, round(sum((xhi - xlo) * (yhi - ylo)) / ((max(xhi) - min(xlo)) * (max(yhi) - min(ylo)))::DOUBLE, 6) AS utilisation FROM boxes")
def bin_stats(t):
    area = F.sum((F.col("xhi") - F.col("xlo")) * (F.col("yhi") - F.col("ylo")))
    whole = (F.max("xhi") - F.min("xlo")) * (F.max("yhi") - F.min("ylo"))
    return t.boxes.agg(F.count("*").alias("cells"), area.alias("area"), F.ceil(F.sqrt(F.count("*"))).alias("ideal_bins"), F.round(area / whole, 6).alias("utilisation"))


_CODE = "list_extract(['R0', 'R90', 'R180', 'R270', 'MY', 'MYR90', 'MX', 'MXR90'], (v % 8 + 1)::INT)"


@query(f"""AND o AS (SELECT v, x, y, {_CODE} AS code FROM coords) SELECT v, code,
 CASE code WHEN 'R0' THEN x WHEN 'R90' THEN -y WHEN 'R180' THEN -x WHEN 'R270' THEN y WHEN 'MY' THEN -x WHEN 'MYR90' THEN -y WHEN 'MX' THEN x ELSE y END AS ox,
 CASE code WHEN 'R0' THEN y WHEN 'R90' THEN x WHEN 'R180' THEN -y WHEN 'R270' THEN -x WHEN 'MY' THEN y WHEN 'MYR90' THEN -x WHEN 'MX' THEN -y ELSE x END AS oy FROM o""")
def orient_transform(t):
    code = F.element_at(F.array(*[F.lit(c) for c in ("R0", "R90", "R180", "R270", "MY", "MYR90", "MX", "MXR90")]), (F.col("v") % 8 + 1).cast("int"))
    own = t.coords.withColumn("code", code)
    ox, oy = spatial.orient(F.col("x"), F.col("y"), F.col("code"))
    return own.select("v", "code", ox.alias("ox"), oy.alias("oy"))


@query(f"""AND o AS (SELECT v, x, y, p_size % 7 + 1 AS w, p_size % 5 + 1 AS h, {_CODE} AS code FROM coords JOIN part ON p_partkey = v)
 SELECT v, x AS xlo, y AS ylo, x + CASE WHEN code LIKE '%90' OR code = 'R270' THEN h ELSE w END AS xhi, y + CASE WHEN code LIKE '%90' OR code = 'R270' THEN w ELSE h END AS yhi FROM o""")
def instance_bbox(t):
    code = F.element_at(F.array(*[F.lit(c) for c in ("R0", "R90", "R180", "R270", "MY", "MYR90", "MX", "MXR90")]), (F.col("v") % 8 + 1).cast("int"))
    own = t.coords.join(t.part.selectExpr("p_partkey v", "cast(p_size as bigint) s"), "v")
    return own.select("v", *spatial.instance_box(F.col("s") % 7 + 1, F.col("s") % 5 + 1, F.col("x"), F.col("y"), code))


_POINTS = "SELECT p_partkey AS id, i AS pos, (p_partkey % 10 + CASE WHEN i IN (1, 2) THEN 5 ELSE 0 END)::BIGINT AS x, (CASE WHEN i IN (2, 3) THEN 3 + p_size % 4 ELSE 0 END * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS y FROM part"


@query(f"""AND p AS ({_POINTS}, range(0, 4) r(i)), a AS (SELECT id, sum(x * ny - nx * y) AS a FROM (SELECT id, x, y, coalesce(lead(x) OVER w, arg_min(x, pos) OVER q) AS nx, coalesce(lead(y) OVER w, arg_min(y, pos) OVER q) AS ny
  FROM p WINDOW w AS (PARTITION BY id ORDER BY pos), q AS (PARTITION BY id)) GROUP BY id)
 SELECT id, CASE WHEN any_value(a) > 0 THEN list(x ORDER BY pos DESC) ELSE list(x ORDER BY pos) END AS xs, CASE WHEN any_value(a) > 0 THEN list(y ORDER BY pos DESC) ELSE list(y ORDER BY pos) END AS ys FROM p JOIN a USING (id) GROUP BY id""")
def polygon_clockwise(t):
    p = t.spark.range(5).withColumnRenamed("id", "i").crossJoin(t.part)  # four corners and the closing point
    pts = p.selectExpr("p_partkey id", "i pos", "cast(p_partkey % 10 + if(i in (1, 2), 5, 0) as bigint) x", "cast(if(i in (2, 3), 3 + p_size % 4, 0) * if(p_partkey % 2 = 0, 1, -1) as bigint) y")
    return spatial.clockwise(pts)


@query("""AND a AS (SELECT e, v, x FROM pins JOIN coords USING (v)), b AS (SELECT p.v, p.e, min(o.x) AS lo, max(o.x) AS hi FROM a p JOIN a o ON p.e = o.e AND p.v <> o.v GROUP BY p.v, p.e),
 l AS (SELECT v, list_sort(flatten(list([lo, hi]))) AS b FROM b GROUP BY v) SELECT v, b[(len(b) // 2)::INT] AS x_lo, b[(len(b) // 2 + 1)::INT] AS x_hi FROM l""")
def optimal_region(t):
    return spatial.optimal_region(t.h.pins, t.coords)


@query("""AND a AS (SELECT DISTINCT x, y FROM coords WHERE v % 3 = 0), b AS (SELECT DISTINCT x, y FROM coords WHERE v % 2 = 0)
 SELECT x, y FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def raster_xor(t):
    a, b = (t.coords.where(f"v % {k} = 0").select("x", "y").distinct() for k in (3, 2))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


@query("SELECT v, 100 - x AS mx, y AS my, 2 * (p_size % 7 + p_size % 5 + 2)::BIGINT AS perimeter FROM coords JOIN part ON p_partkey = v")
def mirror_perimeter(t):
    return t.coords.join(t.part.selectExpr("p_partkey v", "cast(p_size as bigint) s"), "v").selectExpr("v", "100 - x mx", "y my", "2 * (s % 7 + s % 5 + 2) perimeter")


#: suppliers are pins and parts are slots, dealt to sections of four pins
_COSTS = """k AS (SELECT greatest(count(*) // 4, 1) AS k FROM supplier),
 c AS (SELECT s_suppkey % k AS section, s_suppkey AS pin, p_partkey AS slot, abs(s_suppkey * 37 % 101 - p_partkey * 53 % 101)::BIGINT AS cost FROM k, supplier JOIN part ON s_suppkey % k = p_partkey % k)"""


def section_costs(t):
    k = max(t.supplier.count() // 4, 1)
    pins = t.supplier.selectExpr(f"s_suppkey % {k} section", "s_suppkey pin")
    slots = t.part.selectExpr(f"p_partkey % {k} section", "p_partkey slot")
    return pins.join(slots, "section").select("section", "pin", "slot", F.abs(F.col("pin") * 37 % 101 - F.col("slot") * 53 % 101).alias("cost"))


@query(f"AND {_COSTS} SELECT section, pin, slot, cost FROM c")
def assignment_costs(t):
    return section_costs(t)


@query(f"""AND {_COSTS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, pin ORDER BY cost, slot) AS r, dense_rank() OVER (PARTITION BY section ORDER BY pin) AS i, (SELECT max(n) FROM (SELECT count(DISTINCT pin) AS n FROM c GROUP BY section)) AS most FROM c) WHERE r <= most),
 w AS (SELECT section, i, [slot] AS used, cost FROM near WHERE i = 1 UNION ALL SELECT w.section, near.i, list_append(used, slot), w.cost + near.cost FROM w JOIN near ON near.section = w.section AND near.i = w.i + 1 AND NOT list_contains(used, slot)),
 full_ AS (SELECT section, max(i) AS pins FROM near GROUP BY section)
 SELECT w.section, pins::BIGINT AS pins, min(cost)::BIGINT AS cost FROM w JOIN full_ ON full_.section = w.section AND w.i = pins GROUP BY 1, 2""")
def pin_assignment(t):
    """The least total cost of each section; SQL tries all choices of each pin's cheapest slots."""
    from netloom.operators import netlist

    costs = section_costs(t)
    best = netlist.assign(costs.withColumn("cost", F.col("cost").cast("double")))
    return best.join(costs, ["section", "pin", "slot"]).groupBy("section").agg(F.count("*").alias("pins"), F.sum("cost").alias("cost"))


@query("""AND q AS (SELECT a.v AS v, b.v AS u, count(*) AS n FROM pins a JOIN pins b ON a.e = b.e AND a.v <> b.v GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, u) AS rank FROM q) SELECT v, u, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 5""")
def topk_neighbors(t):
    from netloom.operators.timing import top_k

    pins = cut_lineage(t.h.pins)
    n = F.count("*").cast("long")
    rows = pins.groupBy("e").agg((n * (n - 1)).alias("k")).agg(F.sum("k")).first()[0] or 0  # pairs before they are counted
    q = dealt(pins, rows, "e").join(dealt(pins.select("e", F.col("v").alias("u")), rows, "e"), "e").where("v <> u")
    q = dealt(dealt(q, rows, "v", "u").groupBy("v", "u").agg(F.count("*").alias("n")), rows, "v")  # a frequent v has a row a neighbour
    return top_k(q.withColumn("m", -F.col("n")), "v", "m", 5, "u").select("v", "u", "n", "rank")


@query("SELECT b.v, count(*)::BIGINT AS inside FROM (SELECT *, v % 4 AS zlo, v % 4 + 1 AS zhi FROM boxes) b JOIN coords c ON c.x // 10 = b.xlo // 10 AND c.y // 10 = b.ylo // 10 AND c.x BETWEEN xlo - 1 AND xhi + 1 AND c.y BETWEEN ylo - 1 AND yhi + 1 AND c.v % 5 BETWEEN zlo AND zhi GROUP BY b.v")
def points_in_boxes_3d(t):
    """Points of the box's own tile of 10 x 10 that its bloated box holds on its layers."""
    b = t.boxes.selectExpr("*", "v % 4 zlo", "v % 4 + 1 zhi", "xlo div 10 tx", "ylo div 10 ty")
    p = t.coords.selectExpr("x px", "y py", "v % 5 layer", "x div 10 tx", "y div 10 ty")
    return b.join(p, ["tx", "ty"]).where(spatial.contains_3d(F.col("px"), F.col("py"), F.col("layer"), 1)).groupBy("v").agg(F.count("*").alias("inside"))
