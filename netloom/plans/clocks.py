"""Timing, power and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import timing
from netloom.plans.registry import query

#: an order line as a path: group = flag, slack = quantity less limit
_PATHS = "paths AS (SELECT l_returnflag AS grp, l_orderkey * 8 + l_linenumber AS vertex, (l_quantity - 10 - l_linenumber)::BIGINT AS slack FROM lineitem)"


def _paths(t):
    return t.lineitem.selectExpr("l_returnflag grp", "l_orderkey * 8 + l_linenumber vertex", "cast(l_quantity - 10 - l_linenumber as bigint) slack")


@query(f"AND {_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY slack, vertex) AS rank FROM paths) SELECT grp, vertex, slack, rank::INT AS rank FROM r WHERE rank <= 10")
def topk_paths(t):
    return timing.top_k(_paths(t), "grp", "slack", 10, "vertex")


@query(f"AND {_PATHS} SELECT slack, vertex FROM paths ORDER BY slack, vertex LIMIT 1")
def worst_slack(t):
    return timing.worst_slack(_paths(t))


@query(f"AND {_PATHS} SELECT min(slack) AS wns, sum(least(slack, 0))::BIGINT AS tns FROM paths")
def wns_tns(t):
    return timing.wns_tns(_paths(t))


@query("""AND f AS (SELECT v, count(*)::BIGINT AS fanout FROM pins GROUP BY v), c AS (SELECT v, fanout, CASE WHEN v % 3 = 0 THEN 25 WHEN v % 2 = 0 THEN 30 ELSE 28 END::BIGINT AS cap FROM f)
 SELECT v, fanout, cap, cap - fanout AS slack FROM c WHERE cap < fanout""")
def fanout_violations(t):
    f = t.h.pins.groupBy("v").agg(F.count("*").alias("fanout"))
    v = timing.limit_violations(f, "fanout", F.expr("if(v % 3 = 0, 25L, null)"), F.expr("if(v % 2 = 0, 30L, null)"), 28)
    return v.select("v", "fanout", F.col("cap").cast("bigint").alias("cap"), F.col("slack").cast("bigint").alias("slack"))


@query("""AND w AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), g AS (SELECT user_id, min(t - b) AS period FROM w WHERE b IS NOT NULL GROUP BY user_id)
 SELECT user_id, period, period - 60000000 AS slack FROM g WHERE period < 60000000""")
def min_period_violations(t):
    g = _gaps(t).groupBy("user_id").agg(F.min("gap").alias("period"))
    return g.select("user_id", "period", (F.col("period") - 60000000).alias("slack")).where("slack < 0")


def _gaps(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    own = t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return own.withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap is not null")


@query("AND w AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, min(g) AS least FROM w WHERE g IS NOT NULL GROUP BY user_id")
def min_delta_time(t):
    return _gaps(t).groupBy("user_id").agg(F.min("gap").alias("least"))


@query("""AND w AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id FROM events WHERE event_type IN ('click', 'view')),
 x AS (SELECT user_id, event_type, t, lead(event_type) OVER k AS nt, lead(t) OVER k AS n FROM w WINDOW k AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT user_id, min(n - t) AS width, min(n - t) - 1000000 AS slack FROM x WHERE event_type = 'click' AND nt = 'view' GROUP BY user_id""")
def min_pulse_width(t):
    from pyspark.sql import Window

    k = Window.partitionBy("user_id").orderBy("t", "event_id")
    own = t.events.where("event_type in ('click', 'view')").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    x = own.select("user_id", "event_type", F.lead("event_type").over(k).alias("nt"), (F.lead("t").over(k) - F.col("t")).alias("w")).where("event_type = 'click' and nt = 'view'")
    return x.groupBy("user_id").agg(F.min("w").alias("width")).select("user_id", "width", (F.col("width") - 1000000).alias("slack"))


@query("""AND s AS (SELECT l_orderkey AS path, l_linenumber AS pos, sum(l_quantity)::BIGINT AS delay FROM lineitem GROUP BY 1, 2)
 SELECT path, pos, (sum(delay) OVER (PARTITION BY path ORDER BY pos))::BIGINT AS arrival FROM s""")
def path_arrival(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("delay"))
    return timing.path_arrival(s)


@query("""AND p AS (SELECT l_shipmode_group AS grp, sum(l_quantity)::BIGINT AS internal, sum(l_linenumber)::BIGINT AS switching, count(*)::BIGINT AS leakage FROM (SELECT *, l_returnflag AS l_shipmode_group FROM lineitem) GROUP BY 1),
 a AS (SELECT grp, internal, switching, leakage FROM p UNION ALL SELECT 'Total', sum(internal), sum(switching), sum(leakage) FROM p), s AS (SELECT sum(internal + switching + leakage) AS w FROM p)
 SELECT grp, internal::BIGINT AS internal, switching::BIGINT AS switching, leakage::BIGINT AS leakage, (internal + switching + leakage)::BIGINT AS total, round(100 * (internal + switching + leakage) / w::DOUBLE, 4) AS share FROM a, s""")
def power_rollup(t):
    return timing.power_rollup(t.lineitem.selectExpr("l_returnflag grp", "cast(l_quantity as bigint) internal", "cast(l_linenumber as bigint) switching", "1L leakage"))


@query("""SELECT l_partkey AS pin, min(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS rise_min, max(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS rise_max,
 min(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS fall_min, max(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS fall_max FROM lineitem GROUP BY 1""")
def rise_fall_minmax(t):
    return timing.min_max_by_edge(t.lineitem.selectExpr("l_partkey pin", "if(l_linestatus = 'O', 'rise', 'fall') edge", "l_linenumber at"))


@query("""AND a AS (SELECT c_custkey AS reg, c_nationkey AS clk, c_custkey * 37 % 101 AS ta FROM customer), l AS (SELECT c_custkey AS src, (c_custkey + 25) % (SELECT count(*) FROM customer) AS dst FROM customer)
 SELECT x.clk, max(abs(x.ta - y.ta))::BIGINT AS skew FROM l JOIN a x ON x.reg = l.src JOIN a y ON y.reg = l.dst AND x.clk = y.clk GROUP BY x.clk""")
def clock_skew(t):
    n = t.customer.count()
    return timing.clock_skew(t.customer.selectExpr("c_custkey reg", "c_nationkey clk", "c_custkey * 37 % 101 at"), t.customer.selectExpr("c_custkey src", f"(c_custkey + 25) % {n} dst"))


@query("""AND a AS (SELECT c_custkey AS reg, c_nationkey AS clk, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS grp, c_custkey * 37 % 101 + CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey % 7 ELSE 0 END AS ta
  FROM customer JOIN nation ON n_nationkey = c_nationkey), l AS (SELECT c_custkey AS src, (c_custkey * 5 + 3) % (SELECT count(*) FROM customer) AS dst FROM customer)
 SELECT src, dst, x.clk AS launch, y.clk AS capture, (x.ta - y.ta)::BIGINT AS skew FROM l JOIN a x ON x.reg = src JOIN a y ON y.reg = dst WHERE x.clk = y.clk OR x.grp IS NULL OR y.grp IS NULL OR x.grp = y.grp""")
def constrained_skews(t):
    """Nations are clocks, regions their groups (clocks of region 0 are in none), even nations have a latency."""
    n = t.customer.count()
    regs = t.customer.selectExpr("c_custkey reg", "c_nationkey clk", "c_custkey * 37 % 101 at")
    launches = t.customer.selectExpr("c_custkey src", f"(c_custkey * 5 + 3) % {n} dst")
    latency = t.nation.where("n_nationkey % 2 = 0").selectExpr("n_nationkey clk", "n_nationkey % 7 late")
    return timing.constrained_skews(regs, launches, latency, t.nation.where("n_regionkey > 0").selectExpr("n_nationkey clk", "n_regionkey grp"))


_RC = """tree AS (SELECT 0::BIGINT AS node, NULL::BIGINT AS parent, 1::BIGINT AS r, 1::BIGINT AS c UNION ALL SELECT p_partkey, (p_partkey - 1) // 3, p_size % 5 + 1, p_size % 3 + 1 FROM part WHERE p_partkey > 0),
 up AS (SELECT node, node AS anc FROM tree UNION ALL SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.anc WHERE tree.parent IS NOT NULL),
 d AS (SELECT anc, sum(c) AS down FROM up JOIN tree USING (node) GROUP BY anc)"""


@query(f"AND {_RC} SELECT up.node, sum(tree.r * d.down)::BIGINT AS delay FROM up JOIN d ON d.anc = up.anc JOIN tree ON tree.node = up.anc GROUP BY up.node")
def elmore_delay(t):
    root = t.spark.sql("SELECT 0L node, cast(null as bigint) parent, 1L r, 1L c")
    return timing.elmore(root.unionAll(t.part.where("p_partkey > 0").selectExpr("p_partkey node", "(p_partkey - 1) div 3 parent", "cast(p_size % 5 + 1 as bigint) r", "cast(p_size % 3 + 1 as bigint) c")))


@query("""AND w AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), x AS (SELECT user_id, event_type, t, lag(event_type) OVER k AS b, lead(t) OVER k AS n FROM w WINDOW k AS (PARTITION BY user_id ORDER BY t, event_type))
 SELECT user_id AS id, count(*) FILTER (b <> event_type)::BIGINT AS toggles, round(coalesce(sum(CASE WHEN event_type = 'click' THEN n - t END) / nullif(sum(n - t), 0)::DOUBLE, 0), 6) AS duty FROM x GROUP BY user_id""")
def switching_activity(t):
    return timing.activity(t.events.select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("value")), "click")


@query("SELECT 'metal' || (l_linenumber % 4) AS layer, max(l_quantity) AS worst, round(avg(l_quantity), 6) AS average FROM lineitem GROUP BY 1")
def ir_drop_report(t):
    return t.lineitem.groupBy(F.concat(F.lit("metal"), F.col("l_linenumber") % 4).alias("layer")).agg(F.max("l_quantity").alias("worst"), F.round(F.avg("l_quantity"), 6).alias("average"))


@query("SELECT l_suppkey AS node, sum(l_quantity)::BIGINT AS current FROM lineitem GROUP BY 1")
def node_current(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("current"))


@query("""AND r AS (SELECT l_orderkey AS net, l_linenumber AS layer, sum(l_quantity) AS wire, max(l_partkey % 7 + 1) AS gate FROM lineitem GROUP BY 1, 2)
 SELECT net, layer, round(wire / gate, 6) AS par, round(sum(wire / gate) OVER (PARTITION BY net ORDER BY layer), 6) AS car, wire / gate > 40 AS violated FROM r""")
def antenna_ratio(t):
    from pyspark.sql import Window

    r = t.lineitem.groupBy(F.col("l_orderkey").alias("net"), F.col("l_linenumber").alias("layer")).agg(F.sum("l_quantity").alias("wire"), F.max(F.col("l_partkey") % 7 + 1).alias("gate"))
    par = F.col("wire") / F.col("gate")
    w = Window.partitionBy("net").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("net", "layer", F.round(par, 6).alias("par"), F.round(F.sum(par).over(w), 6).alias("car"), (par > 40).alias("violated"))


@query("SELECT l_orderkey AS net, sum(l_partkey % 5)::BIGINT AS pin_cap, sum(l_quantity)::BIGINT AS wire_cap, count(*)::BIGINT AS fanout FROM lineitem GROUP BY 1")
def net_caps(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("net")).agg(F.sum(F.col("l_partkey") % 5).alias("pin_cap"), F.sum(F.col("l_quantity").cast("bigint")).alias("wire_cap"), F.count("*").alias("fanout"))


@query("""AND r(lo, hi, model) AS (VALUES (0, 10, 'tiny'), (10, 25, 'small'), (25, 1000, 'large')) SELECT p_partkey AS v, model FROM part LEFT JOIN r ON p_size >= lo AND p_size < hi""")
def range_lookup(t):
    r = t.spark.createDataFrame([(0, 10, "tiny"), (10, 25, "small"), (25, 1000, "large")], "lo int, hi int, model string")
    return t.part.join(F.broadcast(r), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi")), "left").selectExpr("p_partkey v", "model")


@query("""SELECT l_orderkey * 8 + l_linenumber AS id, any_value(coalesce(CASE WHEN l_partkey % 3 = 0 THEN 1.1 END, CASE WHEN l_orderkey % 4 = 0 THEN 0.9 END, 1.0))::DOUBLE AS factor FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey""")
def derate_lookup(t):
    arcs = t.lineitem.selectExpr("l_orderkey * 8 + l_linenumber id", "l_partkey cell", "l_orderkey net").distinct()
    cell = t.part.where("p_partkey % 3 = 0").selectExpr("p_partkey cell", "cast(1.1 as double) factor")
    net = t.orders.where("o_orderkey % 4 = 0").selectExpr("o_orderkey net", "cast(0.9 as double) factor")
    return timing.derate(arcs, cell, net, 1.0)


@query("""AND c AS (SELECT n_nationkey AS clk, n_nationkey % 5 + 2 AS period, n_nationkey % 3 AS off FROM nation),
 g AS (SELECT a.clk AS src, b.clk AS dst, ((b.off - a.off - i * a.period) % b.period + b.period) % b.period AS g, b.period AS p FROM c a, c b, range(0, 7) r(i) WHERE i < b.period)
 SELECT src, dst, min(CASE WHEN g = 0 THEN p ELSE g END)::BIGINT AS gap FROM g GROUP BY src, dst""")
def cycle_accounting(t):
    c = t.nation.selectExpr("n_nationkey clk", "cast(n_nationkey % 5 + 2 as bigint) period", "cast(n_nationkey % 3 as bigint) offset")
    return timing.smallest_positive_gap(c, c)


@query("""SELECT 'no_input_delay' AS reason, count(*)::BIGINT AS n FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1)
 UNION ALL SELECT 'no_output_delay', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'multiple_clock', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 2)
 UNION ALL SELECT 'unconstrained', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')""")
def check_timing(t):
    n = lambda df, why: df.agg(F.lit(why).alias("reason"), F.count("*").alias("n"))
    lines = t.lineitem
    none = lambda left, key, right, other: left.join(right.select(F.col(other).alias(key)), key, "left_anti")
    many = lines.groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("k")).where("k > 2")
    return (n(none(t.supplier, "s_suppkey", lines.where("l_linenumber = 1"), "l_suppkey"), "no_input_delay").unionAll(n(none(t.orders, "o_orderkey", lines, "l_orderkey"), "no_output_delay"))
            .unionAll(n(many, "multiple_clock")).unionAll(n(none(t.part, "p_partkey", lines.where("l_linestatus = 'O'"), "l_partkey"), "unconstrained")))


@query("SELECT p_partkey AS v, round(0.5 + 0.25 * p_size, 6)::DOUBLE AS delay FROM part")
def linear_delay(t):
    from netloom.functions.scalar import linear_delay as f

    return t.part.select(F.col("p_partkey").alias("v"), F.round(f(F.lit(0.5), F.lit(0.25), F.col("p_size")), 6).alias("delay"))


@query("""AND c AS (SELECT p_partkey AS config, round(0.5 * p_retailprice / 1000 + 0.3 * p_size / 25 + 0.2 * (p_partkey % 10) / 10, 6) * CASE WHEN p_partkey % 17 = 0 THEN 10 ELSE 1 END AS cost FROM part)
 SELECT config, round(cost, 6) AS cost FROM c ORDER BY round(cost, 6), config LIMIT 1""")
def tuner_best(t):
    own = t.part.selectExpr("p_partkey config", "round(0.5D * p_retailprice / 1000 + 0.3D * p_size / 25 + 0.2D * (p_partkey % 10) / 10, 6) * if(p_partkey % 17 = 0, 10, 1) cost")
    return own.agg(F.min(F.struct(F.round("cost", 6).alias("cost"), "config")).alias("m")).select("m.config", "m.cost")


@query("SELECT l_orderkey * 8 + l_linenumber AS pin, (l_extendedprice - 60000)::DOUBLE AS slew, 25000.0::DOUBLE AS cap, 25000 - (l_extendedprice - 60000) AS slack FROM lineitem WHERE l_extendedprice - 60000 > 25000")
def slew_violations(t):
    s = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pin"), (F.col("l_extendedprice") - 60000).alias("slew"))
    return timing.limit_violations(s, "slew", F.lit(None).cast("double"), F.lit(None).cast("double"), 25000).select("pin", "slew", F.col("cap").cast("double").alias("cap"), "slack")


@query("""AND c AS (SELECT l_orderkey AS net, sum(l_quantity)::DOUBLE AS load, CASE WHEN l_orderkey % 4 = 0 THEN 90 ELSE 120 END::DOUBLE AS cap FROM lineitem GROUP BY 1) SELECT net, load, cap, cap - load AS slack FROM c WHERE cap < load""")
def capacitance_violations(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("net")).agg(F.sum("l_quantity").alias("load"))
    v = timing.limit_violations(c, "load", F.expr("if(net % 4 = 0, 90, null)"), F.lit(None).cast("int"), 120)
    return v.select("net", "load", F.col("cap").cast("double").alias("cap"), "slack")


@query("""AND k AS (SELECT l_orderkey * 8 + l_linenumber AS check_id, abs(l_quantity - l_linenumber * 5)::DOUBLE AS skew FROM lineitem) SELECT check_id, skew, 20 - skew AS slack, row_number() OVER (ORDER BY 20 - skew, check_id) AS rank FROM k""")
def max_skew_checks(t):
    return timing.max_skew_checks(t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("check_id"), F.col("l_quantity").alias("clk_at"), (F.col("l_linenumber") * 5.0).alias("ref_at"), F.lit(20.0).alias("most")))


@query("""AND p AS (SELECT l_returnflag AS grp, l_suppkey AS endpoint, l_orderkey * 8 + l_linenumber AS path, l_quantity - 25 AS slack, l_partkey AS pins FROM lineitem),
 u AS (SELECT *, row_number() OVER (PARTITION BY grp, endpoint, pins ORDER BY slack, path) AS s FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY grp, endpoint ORDER BY slack, path) AS k FROM u WHERE s = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY slack, path) AS rank FROM q WHERE k <= 2) SELECT grp, endpoint, path, slack, rank::INT AS rank FROM r WHERE rank <= 50""")
def endpoint_paths(t):
    p = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("endpoint"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("path"), (F.col("l_quantity") - 25).alias("slack"), F.col("l_partkey").alias("pins"))
    return timing.endpoint_paths(p, 50, 2, unique_pins=True)


@query("""AND s AS (SELECT l_partkey AS node, c AS corner, min(l_quantity * CASE c WHEN 'fast' THEN 2 WHEN 'slow' THEN 1 ELSE 1.5 END - 20)::DOUBLE AS slack FROM lineitem, (VALUES ('fast'), ('slow'), ('typical')) x(c) GROUP BY 1, 2)
 SELECT node, arg_min(corner, (slack, corner)) AS corner, min(slack) AS slack FROM s GROUP BY node""")
def worst_corner(t):
    factor = F.explode(F.array(*[F.struct(F.lit(c).alias("corner"), F.lit(f).alias("f")) for c, f in (("fast", 2.0), ("slow", 1.0), ("typical", 1.5))])).alias("c")
    s = t.lineitem.select(F.col("l_partkey").alias("node"), "l_quantity", factor).groupBy("c.corner", "node").agg(F.min(F.col("l_quantity") * F.col("c.f") - 20).alias("slack"))
    return timing.worst_corner(s)
