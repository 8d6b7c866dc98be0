"""Netlist, legalisation, assignment and packing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.operators import cuts, netlist
from netloom.plans.registry import query


@query("""AND r AS (SELECT s_suppkey AS inst FROM supplier WHERE s_suppkey % 2 = 0), p AS (SELECT l_suppkey AS inst, l_orderkey * 8 + l_linenumber AS pin, CASE l_linenumber WHEN 1 THEN 'clk' WHEN 2 THEN 'async' WHEN 3 THEN 'output' ELSE 'data' END AS kind, l_returnflag AS clock, l_linestatus AS edge FROM lineitem)
 SELECT inst, pin, kind FROM p WHERE inst IN (SELECT inst FROM r) AND inst IN (SELECT inst FROM p WHERE kind = 'clk' AND clock = 'R' AND edge = 'F')""")
def register_pins(t):
    pins = t.lineitem.selectExpr("l_suppkey inst", "l_orderkey * 8 + l_linenumber pin", "case l_linenumber when 1 then 'clk' when 2 then 'async' when 3 then 'output' else 'data' end kind", "l_returnflag clock", "l_linestatus edge")
    return netlist.registers(t.supplier.selectExpr("s_suppkey inst", "s_suppkey % 2 = 0 sequential"), pins, "R", "F")


@query("""AND arc AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
 w AS (SELECT 'c' || s_suppkey AS clock, 's' || s_suppkey AS node FROM supplier UNION SELECT clock, dst FROM w JOIN arc ON src = node) SELECT clock, node FROM w""")
def clock_nets(t):
    edge = lambda a, b: t.lineitem.select(F.concat(F.lit(a[0]), a[1]).alias("src"), F.concat(F.lit(b[0]), b[1]).alias("dst")).distinct()
    arcs = edge(("s", "l_suppkey"), ("p", "l_partkey")).unionAll(edge(("p", "l_partkey"), ("o", "l_orderkey")))
    return netlist.clock_nets(t.supplier.selectExpr("concat('c', s_suppkey) clock", "concat('s', s_suppkey) node"), arcs)


@query("""AND q AS (SELECT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b FROM part), tree AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent, p_size % 9 + 5 AS late, p_size % 5 AS early FROM part),
 up AS (SELECT node, node AS anc FROM tree UNION ALL SELECT up.node, parent FROM up JOIN tree ON tree.node = anc WHERE parent IS NOT NULL), l AS (SELECT a, b, max(x.anc) AS pin FROM q JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc GROUP BY a, b)
 SELECT a, b, pin, late - early AS credit FROM l JOIN tree ON node = pin""")
def common_path_credit(t):
    n = t.part.count()
    tree = t.part.selectExpr("p_partkey node", "if(p_partkey > 0, (p_partkey - 1) div 2, null) parent", "p_size % 9 + 5 late", "p_size % 5 early")
    return netlist.common_path_credit(tree, t.part.selectExpr("p_partkey a", f"(p_partkey * 7 + 3) % {n} b"))


@query("""AND m AS (SELECT p_brand || '-' || p_size AS master, list(DISTINCT p_partkey % 3 ORDER BY p_partkey % 3) AS terms FROM part GROUP BY 1), w AS (SELECT p_partkey AS inst, p_brand || '-' || p_size AS old, p_brand || '-' || (p_size % 50 + 1) AS new FROM part)
 SELECT inst, coalesce(a.terms = b.terms, false) AS ok FROM w LEFT JOIN m a ON a.master = old LEFT JOIN m b ON b.master = new""")
def swap_master_check(t):
    """Masters are brands in one size, with one to three terminals; each part would take its brand's next size."""
    terms = t.part.selectExpr("concat(p_brand, '-', p_size) master", "p_partkey % 3 term")
    return netlist.swappable(terms, t.part.selectExpr("p_partkey inst", "concat(p_brand, '-', p_size) old", "concat(p_brand, '-', p_size % 50 + 1) new"))


@query("""SELECT l_orderkey AS net, count(*)::BIGINT AS n_cc, max(l_linenumber) AS max_node, (1.5 * sum(l_quantity))::DOUBLE AS coupling FROM lineitem WHERE l_linenumber > 1 GROUP BY 1""")
def net_coupling(t):
    return t.lineitem.where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("net")).agg(F.count("*").alias("n_cc"), F.max("l_linenumber").alias("max_node"), (1.5 * F.sum("l_quantity")).alias("coupling"))


@query("""AND c(corner, f) AS (VALUES ('fast', 0.5::DOUBLE), ('slow', 2.0::DOUBLE)) SELECT corner, l_partkey AS pin, count(*)::BIGINT AS fanout, f * sum(l_quantity) AS cap FROM lineitem, c GROUP BY corner, f, l_partkey""")
def corner_caps(t):
    corners = t.spark.createDataFrame([("fast", 0.5), ("slow", 2.0)], "corner string, f double")
    own = t.lineitem.groupBy(F.col("l_partkey").alias("pin")).agg(F.count("*").alias("fanout"), F.sum("l_quantity").alias("q"))
    return own.crossJoin(F.broadcast(corners)).select("corner", "pin", "fanout", (F.col("f") * F.col("q")).alias("cap"))


@query("SELECT user_id AS owner, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def property_table(t):
    return netlist.property_table(t.events.selectExpr("user_id owner", "event_type name", "value"), ["click", "view"])


@query("AND g(grp, p) AS (VALUES ('reds', 'red %'), ('nuts', '% _ut%')) SELECT grp, p_name || '/' || p_partkey AS inst FROM part JOIN g ON p_name || '/' || p_partkey LIKE p")
def pattern_groups(t):
    g = t.spark.createDataFrame([("reds", "red *"), ("nuts", "* ?ut*")], "grp string, pattern string")
    return netlist.pattern_members(g, t.part.selectExpr("concat(p_name, '/', p_partkey) inst"))


@query("""AND s AS (SELECT l_orderkey AS net, l_partkey % 3 AS x, l_linenumber AS l, l_quantity > 48 AS wire FROM lineitem), a AS (SELECT net, count(*) FILTER (wire) AS wires, count(DISTINCT x) FILTER (NOT wire) AS places, min(l) AS low FROM s GROUP BY net)
 SELECT net, any_value(wires) = 0 AND any_value(places) <= count(*) FILTER (l_linenumber % 4 >= low) AS stacked FROM a JOIN lineitem ON l_orderkey = net GROUP BY net""")
def stacked_vias(t):
    seg = t.lineitem.selectExpr("l_orderkey net", "l_partkey % 3 x1", "0 y1", "l_linenumber l1", "if(l_quantity > 48, l_partkey % 3 + 1, l_partkey % 3) x2", "0 y2", "l_linenumber + 1 l2")
    return netlist.stacked_via_nets(seg, t.lineitem.selectExpr("l_orderkey net", "l_linenumber % 4 layer"))


@query("AND m AS (SELECT x // 10 AS tx, l_linenumber % 2 AS dir, sum(l_quantity) AS usage, count(*) * 30 AS capacity FROM lineitem JOIN coords ON v = l_partkey GROUP BY 1, 2) SELECT tx, dir, usage, capacity::BIGINT AS capacity, round(usage / capacity, 6) AS ratio FROM m")
def congestion_modes(t):
    own = t.lineitem.join(t.coords, F.col("v") == F.col("l_partkey")).groupBy(F.expr("x div 10").alias("tx"), (F.col("l_linenumber") % 2).alias("dir"))
    m = own.agg(F.sum("l_quantity").alias("usage"), (F.count("*") * 30).alias("capacity"))
    return m.select("*", F.round(F.try_divide("usage", "capacity"), 6).alias("ratio"))


@query("SELECT count(*) FILTER (p_type = 'ECONOMY')::BIGINT AS flops, count(*) FILTER (p_type <> 'ECONOMY')::BIGINT AS combinational FROM part")
def gate_counts(t):
    return t.part.agg(F.count_if(F.col("p_type") == "ECONOMY").alias("flops"), F.count_if(F.col("p_type") != "ECONOMY").alias("combinational"))


@query("SELECT count(DISTINCT l_orderkey)::BIGINT AS nets, count(*)::BIGINT AS rsegs, count(*) FILTER (l_linenumber > 1)::BIGINT AS ccs FROM lineitem")
def extraction_counts(t):
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("nets"), F.count("*").alias("rsegs"), F.count_if(F.col("l_linenumber") > 1).alias("ccs"))


@query("AND d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n::BIGINT AS n, (n - lag(n) OVER (ORDER BY day))::BIGINT AS change FROM d")
def iteration_trend(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.select("day", "n", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("change"))  # one row a day


@query("""AND s AS (SELECT k AS solution, v, (v // k) % 2 AS part FROM vertices, range(1, 17) r(k)), span AS (SELECT solution, e FROM pins JOIN s USING (v) GROUP BY 1, 2 HAVING min(part) <> max(part))
 SELECT solution, sum(hwt)::BIGINT AS cut FROM span JOIN hyperedges USING (e) GROUP BY solution ORDER BY cut, solution LIMIT 10""")
def best_solutions(t):
    """The ten of sixteen initial solutions that cut least: blocks of 1 to 16 neighbouring vertices in turn."""
    every = t.h.vertices.select("v", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(16).cast("bigint"))).alias("solution"))
    return cuts.best_of(t.h, every.selectExpr("solution", "v", "cast((v div solution) % 2 as int) part"), 10)


@query("AND f AS (SELECT e, count(*) AS n FROM pins GROUP BY e) SELECT e, CASE WHEN n <= 1 THEN 1.0 WHEN n <= 2 THEN 1.8 WHEN n <= 4 THEN 3.0 ELSE 3.0 + 0.5 * (n - 4) END::DOUBLE AS length FROM f")
def wireload_length(t):
    return t.h.sizes().select("e", netlist.wireload(F.col("size"), {1: 1.0, 2: 1.8, 4: 3.0}, 0.5).alias("length"))


@query("""SELECT l_orderkey * 8 + l_linenumber AS path, greatest(least(l_quantity, 40) - 25, 0)::DOUBLE AS borrowed, (25 + greatest(least(l_quantity, 40) - 25, 0))::DOUBLE AS start FROM lineitem""")
def latch_borrowing(t):
    b, s = netlist.latch_borrow(F.col("l_quantity"), F.lit(25.0), F.lit(40.0))
    return t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"), b.cast("double").alias("borrowed"), s.cast("double").alias("start"))


@query("""SELECT p_partkey AS v, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN ['R0', 'MX', 'MY', 'R180'] WHEN p_size % 2 = 0 THEN ['R0', 'MX'] WHEN p_size % 3 = 0 THEN ['R0', 'MY'] ELSE ['R0'] END AS orients FROM part""")
def legal_orients(t):
    return t.part.select(F.col("p_partkey").alias("v"), netlist.legal_orients(F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("orients"))


@query("""AND n AS (SELECT e, count(*) AS n FROM pins GROUP BY e HAVING count(*) <= 200), hop AS (SELECT x.v AS src, y.v AS dst, min(abs(x.v - y.v) % 9 + 1)::BIGINT AS d FROM pins x JOIN n USING (e) JOIN pins y ON x.e = y.e AND y.v % 3 = x.v % 3 + 1 GROUP BY 1, 2),
 two AS (SELECT a.src, b.dst, a.d + b.d AS d FROM hop a JOIN hop b ON a.dst = b.src)
 SELECT src % 50 AS port_in, dst % 50 AS port_out, max(d)::BIGINT AS delay FROM two GROUP BY 1, 2""")
def timing_model(t):
    """Port to port: the largest delay over paths from parts of class 0 by class 1 to class 2, nets of at most 200 pins."""
    from netloom.operators.hypergraph import max_fanout

    p = max_fanout(t.h, 200).pins
    q = p.select("e", F.col("v").alias("u"))
    hop = p.join(q, "e").where("u % 3 = v % 3 + 1").groupBy(F.col("v").alias("src"), F.col("u").alias("dst")).agg(F.min(F.abs(F.col("v") - F.col("u")) % 9 + 1).alias("delay"))
    return netlist.timing_model(hop, F.col("src") % 50, F.col("dst") % 50, hops=2)


@query("""AND p AS (SELECT l_orderkey AS net, l_partkey AS p, l_linenumber AS i FROM lineitem), w AS (SELECT net, min(p) AS a, max(p) AS b FROM p GROUP BY net, i // 3),
 ends AS (SELECT net, a AS p FROM w UNION SELECT net, b FROM w), walk AS (SELECT net, p, p AS c FROM ends UNION SELECT k.net, CASE WHEN w.a = k.p THEN w.b ELSE w.a END, k.c FROM walk k JOIN w ON w.net = k.net AND (w.a = k.p OR w.b = k.p)),
 comp AS (SELECT net, p, min(c) AS c FROM walk GROUP BY net, p) SELECT net, count(DISTINCT c)::BIGINT AS islands FROM comp GROUP BY net""")
def wire_islands(t):
    """Each order's lines are drawn as wires of up to three lines, from the least to the largest part; a net may fall apart."""
    own = t.lineitem.selectExpr("l_orderkey net", "l_partkey p", "l_linenumber div 3 g")
    return netlist.wire_islands(own.groupBy("net", "g").agg(F.min("p").alias("a"), F.max("p").alias("b")).select("net", "a", "b"))


@query("SELECT part, sum(vwt)::BIGINT AS w0, sum(v % 5)::BIGINT AS w1, round((2.0 * sum(vwt) + 0.5 * sum(v % 5))::DOUBLE, 6) AS combined FROM vertices JOIN parts2 USING (v) GROUP BY part")
def multi_weight_balance(t):
    """Weights of several dimensions summed as an array and combined by factors."""
    own = t.h.vertices.join(t.parts(), "v").groupBy("part").agg(F.array(F.sum("vwt"), F.sum(F.col("v") % 5)).alias("w"))
    factor = F.array(F.lit(2.0), F.lit(0.5))
    total = F.aggregate(F.zip_with("w", factor, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return own.select("part", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"), F.round(total, 6).alias("combined"))


@query("""AND s AS (SELECT l_orderkey AS e, min(l_quantity - 20) AS slack FROM lineitem GROUP BY 1) SELECT e, round(pow(1 + greatest(-slack, 0) / 20, 2), 6) AS weight FROM s""")
def slack_weights(t):
    """Net weights that grow with negative slack, raised to an exponent."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("e")).agg(F.min(F.col("l_quantity") - 20).alias("slack"))
    return s.select("e", F.round(F.pow(1 + F.greatest(-F.col("slack"), F.lit(0.0)) / 20, 2), 6).alias("weight"))


@query("""AND c AS (SELECT y AS row, v AS cell, x * 7 % 90 AS x, (p_size % 3 + 1)::BIGINT AS width FROM coords JOIN part ON p_partkey = v),
 o AS (SELECT row, cell, row_number() OVER k AS i, sum(width) OVER k - width AS before, x - (sum(width) OVER k - width) AS y FROM c WINDOW k AS (PARTITION BY row ORDER BY x, cell ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, sum(y) OVER (PARTITION BY row ORDER BY i) AS total FROM o),
 m AS (SELECT a.row, a.i AS j, b.i AS k, (b.total - a.total + a.y)::DOUBLE / (b.i - a.i + 1) AS mean FROM s a JOIN s b ON a.row = b.row AND a.i <= b.i),
 least AS (SELECT row, j, k AS i, min(mean) OVER (PARTITION BY row, j ORDER BY k DESC) AS z FROM m)
 SELECT s.row, cell, round(max(z) + any_value(before), 6) AS x FROM s JOIN least ON least.row = s.row AND least.i = s.i GROUP BY s.row, cell""")
def shift_legalise(t):
    """SQL takes the least squares places as the largest of least means of runs."""
    out = netlist.shift_legalise(t.coords.join(t.part.selectExpr("p_partkey v", "cast(p_size % 3 + 1 as bigint) width"), "v").selectExpr("y row", "v cell", "x * 7 % 90 x", "width"))
    return out.select("row", "cell", F.round("x", 6).alias("x"))


@query("""AND c AS (SELECT y AS row, v AS cell, x, v % 3 + 1 AS width, x * 7 % 90 AS wish, row_number() OVER (PARTITION BY y ORDER BY x, v) - 1 AS n FROM coords), m AS (SELECT *, n // 3 AS w, n % 3 AS i FROM c),
 g AS (SELECT row, w, min(x) AS x0, max(n % 3) + 1 AS size FROM m GROUP BY row, w),
 o AS (SELECT g.row, g.w, g.size, a.cell AS c0, b.cell AS c1, d.cell AS c2, a.i * 9 + coalesce(b.i, 0) * 3 + coalesce(d.i, 0) AS rank,
   abs(x0 - a.wish) + coalesce(abs(x0 + a.width - b.wish), 0) + coalesce(abs(x0 + a.width + b.width - d.wish), 0) AS cost
  FROM g JOIN m a ON a.row = g.row AND a.w = g.w LEFT JOIN m b ON b.row = g.row AND b.w = g.w AND b.i <> a.i LEFT JOIN m d ON d.row = g.row AND d.w = g.w AND d.i <> a.i AND d.i <> b.i),
 best AS (SELECT *, row_number() OVER (PARTITION BY row, w ORDER BY cost, rank) AS r FROM o)
 SELECT row, w AS "window", 0 AS place, c0 AS cell FROM best WHERE r = 1 UNION ALL SELECT row, w, 1, c1 FROM best WHERE r = 1 AND size > 1 UNION ALL SELECT row, w, 2, c2 FROM best WHERE r = 1 AND size > 2""")
def reorder_windows(t):
    return netlist.reorder_windows(t.coords.selectExpr("y row", "v cell", "x", "v % 3 + 1 width", "x * 7 % 90 wish"))


@query("""AND b AS (SELECT p_partkey // 12 AS pair, p_partkey AS block, p_partkey * 7 % 13 AS f, p_partkey * 5 % 13 AS s, (p_size % 5 + 1)::DOUBLE AS w, (p_size % 7 + 1)::DOUBLE AS h FROM part),
 px AS (SELECT pair, block, 0.0::DOUBLE AS x, 0 AS n FROM b UNION ALL SELECT r.pair, r.block, max(px.x + l.w), any_value(px.n) + 1 FROM px JOIN b l ON l.block = px.block JOIN b r ON r.pair = l.pair AND l.f < r.f AND l.s < r.s GROUP BY r.pair, r.block),
 py AS (SELECT pair, block, 0.0::DOUBLE AS y, 0 AS n FROM b UNION ALL SELECT r.pair, r.block, max(py.y + l.h), any_value(py.n) + 1 FROM py JOIN b l ON l.block = py.block JOIN b r ON r.pair = l.pair AND l.f > r.f AND l.s < r.s GROUP BY r.pair, r.block)
 SELECT pair, block, x, y FROM (SELECT pair, block, max(x) AS x FROM px GROUP BY 1, 2) JOIN (SELECT pair, block, max(y) AS y FROM py GROUP BY 1, 2) USING (pair, block)""")
def sequence_pair_packing(t):
    """All parts, in packings of twelve."""
    b = t.part.selectExpr("p_partkey div 12 pair", "p_partkey block", "p_partkey * 7 % 13 first", "p_partkey * 5 % 13 second", "cast(p_size % 5 + 1 as double) w", "cast(p_size % 7 + 1 as double) h")
    return netlist.pack_sequence_pairs(b)


@query(None)
def annealed_packing(t):
    """All parts, in packings of eight; that boxes don't overlap and fit the area is tested on a fixture."""
    return netlist.anneal_packings(t.part.selectExpr("p_partkey div 8 grp", "p_partkey block", "p_size % 5 + 1 w", "p_size % 7 + 1 h"))


@query(None)
def kmeans_rounds(t):
    x = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda a: a.cast("double")).alias("x"))
    return netlist.kmeans(x, 10, 300)
