"""Queries of incremental timing, modularity, balanced clusters and spanning trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import balanced, coarsen, graph, incremental, modularity, spatial, trees
from netloom.operators.hypergraph import Hypergraph
from netloom.plans.graphs import _LAYERS, _SYM, _layers, _sym
from netloom.plans.registry import query

#: some arcs of the layers go and some new ones come, with a longer delay
_CHANGED = _LAYERS.split("w AS (")[0].replace("arc AS (SELECT", "old AS (SELECT", 1) + """arc AS (SELECT src, dst, delay FROM old WHERE (src + dst) % 11 > 0
  UNION ALL SELECT v, v + 1, (v % 4 + 6)::BIGINT FROM vertices WHERE v % 5 = 0 AND v % 8 < 7 AND v + 1 IN (SELECT v FROM vertices)),
 w AS (SELECT v, v % 8 AS k, 0::BIGINT AS late, 0 AS level FROM vertices WHERE v % 8 = 0
  UNION ALL SELECT x.v, any_value(x.v % 8), coalesce(max(w.late + delay), 0), coalesce(max(w.level) + 1, 0) FROM vertices x LEFT JOIN arc ON dst = x.v LEFT JOIN w ON w.v = src
   WHERE x.v % 8 = (SELECT max(k) + 1 FROM w) GROUP BY x.v),
 back AS (SELECT v, v % 8 AS k, 60::BIGINT AS required FROM vertices WHERE v % 8 = 7
  UNION ALL SELECT x.v, any_value(x.v % 8), coalesce(min(b.required - delay), 60) FROM vertices x LEFT JOIN arc ON src = x.v LEFT JOIN back b ON b.v = dst WHERE x.v % 8 = (SELECT min(k) - 1 FROM back) GROUP BY x.v)"""


def layer_changes(t):
    """(arcs that go, arcs that come) of the query below."""
    _, arcs = _layers(t)
    v = t.h.vertices.select("v")
    new = v.where("v % 5 = 0 and v % 8 < 7").join(v.select((F.col("v") - 1).alias("v")), "v")
    return arcs.where("(src + dst) % 11 = 0").select("src", "dst"), new.selectExpr("v src", "v + 1 dst", "v % 4 + 6 delay")


@query(f"AND {_CHANGED} SELECT w.v AS node, late AS arrival, level, required, required - late AS slack FROM w JOIN back ON back.v = w.v")
def incremental_slacks(t):
    """Arrival, level, required time and slack after a change set, from the state before it."""
    nodes, arcs = _layers(t)
    return incremental.retime(nodes, arcs, *layer_changes(t), 60)


@query(f"""AND {_SYM}, lab AS (SELECT v, v % 5 AS label FROM node), m AS (SELECT sum(w)::DOUBLE AS m2 FROM sym),
 deg AS (SELECT src AS v, sum(w) AS k FROM sym GROUP BY src), tot AS (SELECT label, sum(k) AS t FROM deg JOIN lab USING (v) GROUP BY label),
 link AS (SELECT s.src AS v, l.label AS target, sum(w) AS k FROM sym s JOIN lab l ON l.v = s.dst GROUP BY 1, 2)
 SELECT link.v, lab.label, link.target, round(1e6::DOUBLE * 2 * ((link.k - coalesce(o.k, 0)) - 1.5::DOUBLE * deg.k * (b.t - a.t + deg.k) / m2) / m2, 4) AS gain
 FROM link JOIN lab ON lab.v = link.v AND lab.label <> link.target JOIN deg ON deg.v = link.v JOIN tot a ON a.label = lab.label JOIN tot b ON b.label = link.target
 LEFT JOIN link o ON o.v = link.v AND o.target = lab.label, m""")
def modularity_gains(t):
    """The gain of every move to a community next to a vertex, in millionths, at resolution 1.5."""
    sym = _sym(t)
    label = sym.select(F.col("src").alias("v")).distinct().selectExpr("v", "v % 5 label")
    return modularity.move_gains(sym, label, 1.5).select("v", "label", "target", F.round(F.col("gain") * 1e6, 4).alias("gain"))


@query(f"""AND {_SYM}, lab AS (SELECT v, v % 5 AS label FROM node), each AS (SELECT a.label, sum(w)::DOUBLE AS t, sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) AS i
 FROM sym JOIN lab a ON a.v = src JOIN lab b ON b.v = dst GROUP BY a.label) SELECT round(sum(i) / sum(t) - 0.5::DOUBLE * sum(t * t) / (sum(t) * sum(t)), 9) AS q FROM each""")
def modularity_score(t):
    sym = _sym(t)
    label = sym.select(F.col("src").alias("v")).distinct().selectExpr("v", "v % 5 label")
    return modularity.modularity(sym, label, 0.5).select(F.round("q", 9).alias("q"))


@query(None)
def modularity_communities(t):
    """The communities of parts and suppliers, at resolution 1."""
    return modularity.communities(_sym(t))[0]


def _points(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda a: a.cast("double")).alias("x"))


@query("""AND p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT p.id, list_distance(p.x, a.x) ** 2 AS d0, list_distance(p.x, b.x) ** 2 AS d1
  FROM p, (SELECT x FROM p WHERE id = 0) a, (SELECT x FROM p WHERE id = 3) b),
 near AS (SELECT *, CASE WHEN d1 < d0 THEN 3 ELSE 0 END AS c, (SELECT (count(*) + 1) // 2 FROM p) AS most FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY CASE c WHEN 0 THEN d1 - d0 ELSE d0 - d1 END, id) AS rn, count(*) OVER (PARTITION BY c) AS n FROM near)
 SELECT id, (CASE WHEN rn <= n - most THEN 3 - c ELSE c END)::BIGINT AS cluster, round(CASE WHEN (rn <= n - most) = (c = 0) THEN d1 ELSE d0 END, 5) AS cost FROM r""")
def balanced_halves(t):
    """The assignment of least cost to two centres that each take half of the points."""
    x = _points(t)
    out = balanced.assign(x, x.where("id in (0, 3)").select(F.col("id").alias("c"), "x"), (t.embeddings.count() + 1) // 2)
    return out.select("id", "cluster", F.round("cost", 5).alias("cost"))


@query(None)
def balanced_kmeans(t):
    """Ten clusters of at most a ninth of the points, to convergence."""
    x = _points(t)
    return balanced.kmeans(x, x.where("id < 10").select(F.col("id").alias("c"), "x"), t.embeddings.count() // 9 + 1)[0]


@query("""AND p AS (SELECT vec_id AS id, label AS c, embedding::DOUBLE[] AS x FROM embeddings),
 d AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.x, b.x) ** 2) AS s, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
 f AS (SELECT id, c, max(CASE WHEN o = c THEN n END) AS n, max(CASE WHEN o = c THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN o <> c THEN s / n END) AS b FROM d GROUP BY id, c)
 SELECT id, c AS cluster, round(CASE WHEN n < 2 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM f""")
def silhouette(t):
    return balanced.silhouette(_points(t), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))).select("id", "cluster", F.round("s", 6).alias("s"))


#: regions, their nations and customers as a forest; hyperedges are the parts, pins the customers who ordered them
_FOREST = """tree AS (SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent, 0::BIGINT AS len FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_nationkey % 7 + 1 FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_custkey % 5 + 1 FROM customer),
 up AS (SELECT node, node AS anc FROM tree UNION ALL SELECT up.node, tree.parent FROM up JOIN tree ON tree.node = up.anc WHERE tree.parent IS NOT NULL),
 far AS (SELECT up.node, sum(len)::BIGINT AS far, min(anc) AS root, count(*) AS depth FROM up JOIN tree ON tree.node = up.anc GROUP BY up.node)"""


def _forest(t):
    """(vertices (v), edges (src, dst, w)) of the forest."""
    n = t.nation.selectExpr("cast(n_nationkey + 100 as bigint) v", "cast(n_regionkey as bigint) up", "cast(n_nationkey % 7 + 1 as bigint) w")
    c = t.customer.selectExpr("cast(c_custkey + 1000 as bigint) v", "cast(c_nationkey + 100 as bigint) up", "cast(c_custkey % 5 + 1 as bigint) w")
    both = n.unionAll(c)
    return t.region.selectExpr("cast(r_regionkey as bigint) v").unionAll(both.select("v")), both.selectExpr("up src", "v dst", "w")


@query(f"""AND {_FOREST}, own AS (SELECT DISTINCT l_partkey AS e, o_custkey + 1000 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 k AS (SELECT e, root, count(*) AS k FROM own JOIN far ON far.node = v GROUP BY e, root), below AS (SELECT e, root, anc, count(*) AS n FROM own JOIN up ON up.node = v JOIN far ON far.node = v GROUP BY 1, 2, 3),
 cut AS (SELECT anc AS node, sum(e % 3 + 1)::BIGINT AS cut FROM below JOIN k USING (e, root) WHERE n < k GROUP BY anc), size AS (SELECT anc AS node, count(*)::BIGINT AS below FROM up GROUP BY anc)
 SELECT node, parent, coalesce(cut, 0)::BIGINT AS cut, below FROM tree LEFT JOIN cut USING (node) JOIN size USING (node) WHERE parent IS NOT NULL""")
def tree_edge_cuts(t):
    """For each edge of the forest the weight of the parts that were ordered on both of its sides, and the nodes below."""
    v, edges = _forest(t)
    pins = t.lineitem.join(t.orders, F.expr("o_orderkey = l_orderkey")).selectExpr("l_partkey e", "o_custkey + 1000 v").distinct()
    h = Hypergraph(v.selectExpr("v", "1L vwt", "cast(null as int) fixed"), pins.selectExpr("e", "e % 3 + 1 hwt").distinct(), pins)
    return trees.edge_cuts(h, trees.preorder(v, edges))


@query(f"""AND {_FOREST}, ask AS (SELECT c_custkey + 1000 AS src, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) + 1000 AS dst, c_custkey % 9 + 1 AS w FROM customer),
 meet AS (SELECT src, dst, w, x.anc, far, row_number() OVER (PARTITION BY src ORDER BY depth DESC) AS n FROM ask JOIN up x ON x.node = src JOIN up y ON y.node = dst AND y.anc = x.anc JOIN far ON far.node = x.anc)
 SELECT src, dst, w, (a.far + b.far - 2 * meet.far)::BIGINT AS distance, round((a.far + b.far - 2 * meet.far) / w::DOUBLE, 6) AS stretch FROM meet JOIN far a ON a.node = src JOIN far b ON b.node = dst WHERE n = 1""")
def tree_stretch(t):
    """Distances on the forest of pairs of customers, over their direct lengths."""
    v, edges = _forest(t)
    order = trees.preorder(v, edges)
    n = t.customer.count()
    arcs = t.customer.selectExpr("c_custkey + 1000 src", f"(c_custkey * 7 + 3) % {n} + 1000 dst", "c_custkey % 9 + 1 w").join(v.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return trees.stretch(order, trees.parent_lengths(order, edges), arcs).select("src", "dst", "w", "distance", F.round("stretch", 6).alias("stretch"))


@query(None)
def low_stretch_tree(t):
    """A low-stretch forest of the parts and suppliers, with the stretch of every arc."""
    arcs = t.lineitem.groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(F.sum("l_linenumber").alias("w"))
    v = arcs.select(F.col("src").alias("v")).union(arcs.select("dst")).distinct()
    edges = trees.low_stretch_forest(v, arcs)
    order = trees.preorder(v, edges)
    return trees.stretch(order, trees.parent_lengths(order, edges), arcs)


@query("""AND p AS (SELECT e, v, count(*) OVER (PARTITION BY e) AS k FROM pins), t AS (SELECT p.*, i AS t, CASE WHEN k > 3 THEN md5('1:' || i || ':' || e || ':' || v) ELSE '' END AS key FROM p, range(0, 3) r(i) WHERE k > 3 OR (k > 1 AND i = 0)),
 n AS (SELECT e, k, v, coalesce(lead(v) OVER w, first_value(v) OVER w) AS nxt FROM t WINDOW w AS (PARTITION BY e, t ORDER BY key, v)),
 a AS (SELECT v AS src, nxt AS dst, CASE k WHEN 2 THEN hwt::DOUBLE WHEN 3 THEN hwt / 2 ELSE hwt / (2 * 3 * (floor(k / 2) * ceil(k / 2) / (k - 1))) END AS w, hwt / (SELECT max(k) FROM p)::DOUBLE AS spread
  FROM n JOIN hyperedges USING (e) WHERE k > 2 OR v < nxt)
 SELECT src, dst, round(sum(w), 6) AS w, round(sum(spread), 6) AS spread FROM (SELECT * FROM a UNION ALL SELECT dst, src, w, spread FROM a) GROUP BY src, dst""")
def cycle_expansion_random(t):
    """Three random cycles a hyperedge, with the second matrix beside."""
    return graph.random_cycles(t.h, 3).select("src", "dst", F.round("w", 6).alias("w"), F.round("spread", 6).alias("spread"))


@query("""AND x AS (SELECT v, [((v * 7919) % 1009)::DOUBLE, (v % 13)::DOUBLE] AS x FROM vertices), p AS (SELECT v, lead(v) OVER (PARTITION BY e ORDER BY (v * 7919) % 1009, v) AS n FROM pins),
 q AS (SELECT least(v, n) AS src, greatest(v, n) AS dst, count(*)::BIGINT AS n FROM p WHERE n IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT q.*, abs(a.x[1] - b.x[1]) AS d1, abs(a.x[2] - b.x[2]) AS d2 FROM q JOIN x a ON a.v = src JOIN x b ON b.v = dst)
 SELECT src, dst, n, d1 + d2 AS length, round(CASE WHEN d1 = 0 THEN 1e9 ELSE 1 / d1 END + CASE WHEN d2 = 0 THEN 1e9 ELSE 1 / d2 END, 6) AS inverse FROM d""")
def spectral_path_lengths(t):
    """The path graph by two coordinates, with both kinds of length."""
    x = t.h.vertices.select("v", F.array(((F.col("v") * 7919) % 1009).cast("double"), (F.col("v") % 13).cast("double")).alias("x"))
    pairs = graph.spectral_path_graph(t.h, x.select("v", F.col("x")[0].alias("x")))
    return graph.path_lengths(pairs, x, both=True).withColumn("inverse", F.round("inverse", 6))


@query("""AND g AS (SELECT p_partkey AS v, p_brand || '/' || p_size AS grp FROM part), c AS (SELECT v, min(v) OVER (PARTITION BY grp) AS cluster FROM g),
 cp AS (SELECT DISTINCT e, cluster AS v FROM pins JOIN c USING (v)), l AS (SELECT e, list(v ORDER BY v) AS pins, any_value(hwt) AS hwt FROM cp JOIN hyperedges USING (e) GROUP BY e HAVING count(*) > 1)
 SELECT min(e) AS e, sum(hwt)::BIGINT AS hwt, any_value(len(pins))::BIGINT AS size FROM l GROUP BY pins""")
def grouped_hypergraph(t):
    """The hyperedges left when parts of one brand and size have to share a block."""
    h, _ = coarsen.contract_groups(t.h, t.part.selectExpr("p_partkey v", "concat(p_brand, '/', p_size) grp"))
    return h.hyperedges.join(h.sizes(), "e")


#: an L of each part: width and height from its size and key, with a bite out of a corner
_CORNERS = [("0", "0"), ("w", "0"), ("w", "h"), ("w - 1", "h"), ("w - 1", "h - 1"), ("0", "h - 1")]


@query(f"""AND o AS (SELECT p_partkey AS id, (p_size % 6 + 2)::BIGINT AS w, (p_partkey % 5 + 2)::BIGINT AS h FROM part),
 pt AS ({" UNION ALL ".join(f"SELECT id, {i} AS pos, {x} AS x, {y} AS y FROM o" for i, (x, y) in enumerate(_CORNERS))})
 SELECT id, 0::BIGINT AS xlo, 0::BIGINT AS ylo, w AS xhi, h - 1 AS yhi FROM o UNION ALL SELECT id, w - 1, h - 1, w, h FROM o""")
def polygon_rectangles(t):
    own = t.part.selectExpr("p_partkey id", "cast(p_size % 6 + 2 as bigint) w", "cast(p_partkey % 5 + 2 as bigint) h")
    corner = F.array(*[F.struct(F.lit(i).alias("pos"), F.expr(f"cast({x} as bigint)").alias("x"), F.expr(f"cast({y} as bigint)").alias("y")) for i, (x, y) in enumerate(_CORNERS)])
    return spatial.rectangles(own.select("id", F.explode(corner).alias("c")).select("id", "c.*"))


@query("""AND a AS (SELECT e, v, x, y FROM pins JOIN coords USING (v)), b AS (SELECT p.v, p.e, min(o.x) AS xlo, max(o.x) AS xhi, min(o.y) AS ylo, max(o.y) AS yhi FROM a p JOIN a o ON p.e = o.e AND p.v <> o.v GROUP BY p.v, p.e),
 l AS (SELECT v, list_sort(flatten(list([xlo, xhi]))) AS bx, list_sort(flatten(list([ylo, yhi]))) AS byy FROM b GROUP BY v),
 r AS (SELECT v, bx[(len(bx) // 2)::INT] AS x_lo, bx[(len(bx) // 2 + 1)::INT] AS x_hi, byy[(len(byy) // 2)::INT] AS y_lo, byy[(len(byy) // 2 + 1)::INT] AS y_hi FROM l),
 c AS (SELECT v, x, y, p_size % 4 AS width FROM coords JOIN part ON p_partkey = v)
 SELECT r.v, u.v AS u FROM r JOIN c ON c.v = r.v JOIN c u ON u.width = c.width AND u.v <> r.v AND u.x BETWEEN x_lo AND x_hi AND u.y BETWEEN y_lo AND y_hi
 WHERE NOT (c.x BETWEEN x_lo AND x_hi AND c.y BETWEEN y_lo AND y_hi)""")
def swap_candidates(t):
    """For each part outside of its optimal region the parts of its width that stand there."""
    return spatial.swap_candidates(spatial.optimal_regions(t.h.pins, t.coords), t.coords.join(t.part.selectExpr("p_partkey v", "p_size % 4 width"), "v"), 4)
