"""Graph queries: components, expansions, Laplacians, trees, levels, sweeps. All read their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import coarsen, graph, sequential
from netloom.plans.registry import query
from netloom.session import cut_lineage

#: components over all hyperedges: each vertex passes on the least label that it has just got, UNION drops known rows
_WHOLE = """walk AS (SELECT v, v AS c FROM vertices UNION SELECT b.v, min(w.c) FROM walk w JOIN pins a ON a.v = w.v JOIN pins b ON b.e = a.e GROUP BY b.v),
 comp AS (SELECT v, min(c) AS component FROM walk GROUP BY v), best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"""


@query(f"AND {_WHOLE} SELECT v, component FROM comp")
def connected_components(t):
    return graph.connected_components(t.h.vertices, t.h.pins)


@query(f"AND {_WHOLE} SELECT v, row_number() OVER (ORDER BY v) AS new_v FROM comp WHERE component = (SELECT component FROM best)")
def largest_island(t):
    return graph.largest_island(graph.connected_components(t.h.vertices, t.h.pins))


@query(f"AND {_WHOLE} SELECT v FROM comp WHERE component <> (SELECT component FROM best)")
def unused_vertices(t):
    c = graph.connected_components(t.h.vertices, t.h.pins)
    return c.select("v").join(graph.largest_island(c), "v", "left_anti")


@query("""AND p AS (SELECT e, v, count(*) OVER (PARTITION BY e) AS k, coalesce(lead(v) OVER (PARTITION BY e ORDER BY v), min(v) OVER (PARTITION BY e)) AS nxt FROM pins),
 a AS (SELECT v AS src, nxt AS dst, CASE k WHEN 2 THEN hwt::DOUBLE WHEN 3 THEN hwt / 2 ELSE hwt / (2 * (floor(k / 2) * ceil(k / 2) / (k - 1))) END AS w FROM p JOIN hyperedges USING (e) WHERE k > 2 OR (k = 2 AND v < nxt))
 SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, w FROM a UNION ALL SELECT dst, src, w FROM a) GROUP BY src, dst""")
def cycle_expansion(t):
    return graph.cycle_expansion(t.h).select("src", "dst", F.round("w", 6).alias("w"))


@query("""AND x AS (SELECT v, (v % 7)::DOUBLE AS x FROM vertices), m AS (SELECT e, avg(x) AS m, count(*) AS k FROM pins JOIN x USING (v) GROUP BY e HAVING count(*) > 1),
 y AS (SELECT v, sum(hwt * (k - 1) / (floor(k / 2) * ceil(k / 2)) * (x - m)) AS y FROM pins JOIN x USING (v) JOIN m USING (e) JOIN hyperedges USING (e) GROUP BY v)
 SELECT v, round(coalesce(y, 0), 6) + 0.0 AS y FROM vertices LEFT JOIN y USING (v)""")
def hypergraph_laplacian(t):
    y = graph.laplacian(t.h, t.h.vertices.select("v", (F.col("v") % 7).cast("double").alias("x")))
    return y.select("v", (F.round("y", 6) + F.lit(0.0)).alias("y"))


@query("""AND s AS (SELECT sum(vwt * (v % 7)) AS wx, sum(vwt) AS sw FROM vertices) SELECT v, round(vwt * (v % 7) - wx * vwt / sw, 6) AS y FROM vertices, s""")
def clique_matvec(t):
    y = graph.clique_matvec(t.h.vertices.selectExpr("v", "vwt w", "v % 7 x"))
    return y.select("v", F.round("y", 6).alias("y"))


@query("""AND b AS (SELECT v, CASE v % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS side, v % 7 AS x FROM vertices)
 SELECT v, (CASE side WHEN 1 THEN (SELECT count(*) FROM b WHERE side = 2) * x - (SELECT sum(x) FROM b WHERE side = 2)
  WHEN 2 THEN (SELECT count(*) FROM b WHERE side = 1) * x - (SELECT sum(x) FROM b WHERE side = 1) ELSE 0 END)::BIGINT AS y FROM b""")
def biclique_matvec(t):
    return graph.biclique_matvec(t.h.vertices.selectExpr("v", "case v % 3 when 1 then 1 when 2 then 2 end side", "v % 7 x"))


@query("""AND b AS (SELECT v, vwt, CASE v % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS side, v % 7 AS x FROM vertices), s AS (SELECT sum(vwt * x) AS wx, sum(vwt) AS sw, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2, sum(x) FILTER (side = 1) AS x1, sum(x) FILTER (side = 2) AS x2 FROM b)
 SELECT v, round(vwt * x - wx * vwt / sw + 10.0::DOUBLE * (CASE side WHEN 1 THEN n2 * x - x2 WHEN 2 THEN n1 * x - x1 ELSE 0 END), 6) AS y FROM b, s""")
def constraint_matvec(t):
    x = t.h.vertices.selectExpr("v", "vwt w", "case v % 3 when 1 then 1 when 2 then 2 end side", "v % 7 x")
    return graph.constraint_matvec(x).select("v", F.round("y", 6).alias("y"))


@query("""AND p AS (SELECT v, lead(v) OVER (PARTITION BY e ORDER BY (v * 7919) % 1009, v) AS n FROM pins)
 SELECT least(v, n) AS src, greatest(v, n) AS dst, count(*)::BIGINT AS n FROM p WHERE n IS NOT NULL GROUP BY 1, 2""")
def spectral_path_graph(t):
    return graph.spectral_path_graph(t.h, t.h.vertices.selectExpr("v", "(v * 7919) % 1009 x"))


_ARCS = """pa AS (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, sum(l_linenumber)::BIGINT AS w FROM lineitem GROUP BY 1, 2)"""


def _arcs(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(F.sum("l_linenumber").alias("w"))


@query(f"""AND {_ARCS}, ends AS (SELECT src AS component, w, src AS a, dst AS b FROM pa UNION ALL SELECT dst, w, src, dst FROM pa),
 r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w, a, b) AS n FROM ends) SELECT component, a AS src, b AS dst, w FROM r WHERE n = 1""")
def boruvka_step(t):
    arcs = _arcs(t)
    ends = arcs.select(F.col("src").alias("v")).union(arcs.select("dst")).distinct()
    return graph.boruvka_step(arcs, ends.select("v", F.col("v").alias("component")))


def _boruvka_sql(rounds: int) -> str:
    """SQL of the minimum spanning forest of pa: each round takes every tree's lightest arc; enough for 2 ** rounds vertices."""
    steps = ["arc0 AS MATERIALIZED (SELECT w, src AS a, dst AS b, src AS ca, dst AS cb FROM pa)"]
    for i in range(rounds):
        steps += [
            f"best{i} AS MATERIALIZED (SELECT c, o, w, a, b FROM (SELECT ca AS c, cb AS o, w, a, b FROM arc{i} UNION ALL SELECT cb, ca, w, a, b FROM arc{i}) QUALIFY row_number() OVER (PARTITION BY c ORDER BY w, a, b) = 1)",
            f"root{i} AS (SELECT x.c, x.c AS r FROM best{i} x JOIN best{i} y ON y.c = x.o AND y.o = x.c AND x.c < y.c UNION ALL SELECT z.c, t.r FROM root{i} t JOIN best{i} z ON z.o = t.c AND z.c <> t.r)",
            f"arc{i + 1} AS MATERIALIZED (SELECT w, a, b, p.r AS ca, q.r AS cb FROM arc{i} JOIN root{i} p ON p.c = ca JOIN root{i} q ON q.c = cb WHERE p.r <> q.r)",
        ]
    return ", ".join(steps) + " " + " UNION ".join(f"SELECT a AS src, b AS dst, w FROM best{i}" for i in range(rounds))


@query(f"AND {_ARCS}, {_boruvka_sql(12)}")
def spanning_forest(t):
    arcs = _arcs(t)
    ends = arcs.select(F.col("src").alias("v")).union(arcs.select("dst")).distinct()
    return graph.minimum_spanning_forest(ends, arcs, directed=True)


_TREE = """tree AS (SELECT 'w' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'w' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
 up AS (SELECT node, node AS anc, 0 AS up FROM tree UNION ALL SELECT up.node, tree.parent, up.up + 1 FROM up JOIN tree ON tree.node = up.anc WHERE tree.parent IS NOT NULL)"""


def _tree(t):
    r = t.region.selectExpr("concat('r', r_regionkey) node", "'w' parent")
    n = t.nation.selectExpr("concat('n', n_nationkey) node", "concat('r', n_regionkey) parent")
    c = t.customer.selectExpr("concat('c', c_custkey) node", "concat('n', c_nationkey) parent")
    return t.spark.sql("SELECT 'w' node, cast(null as string) parent").unionAll(r).unionAll(n).unionAll(c)


@query(f"AND {_TREE} SELECT node, max(up)::INT AS level FROM up GROUP BY node")
def tree_levels(t):
    return graph.tree_levels(_tree(t))


@query(f"""AND {_TREE}, q AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS b FROM customer),
 f AS (SELECT a, b, x.anc, x.up, row_number() OVER (PARTITION BY a, b ORDER BY x.up) AS n FROM q JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc)
 SELECT a, b, anc AS lca FROM f WHERE n = 1""")
def lca_pairs(t):
    n = t.customer.count()
    q = t.customer.selectExpr("concat('c', c_custkey) a", f"concat('c', (c_custkey * 7 + 3) % {n}) b")
    tree = _tree(t)
    return graph.lowest_common_ancestors(tree, q).join(tree.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "lca")


@query("""AND o AS (SELECT v, row_number() OVER (ORDER BY (v * 7919) % 1009, v) AS rank FROM vertices), s AS (SELECT e, min(rank) AS lo, max(rank) AS hi, any_value(hwt) AS hwt FROM pins JOIN o USING (v) JOIN hyperedges USING (e) GROUP BY e),
 d AS (SELECT rank, sum(w) AS d FROM (SELECT lo AS rank, hwt AS w FROM s UNION ALL SELECT hi, -hwt FROM s) GROUP BY rank)
 SELECT o.rank, (sum(coalesce(d, 0)) OVER (ORDER BY o.rank))::BIGINT AS cut FROM o LEFT JOIN d ON d.rank = o.rank""")
def sweep_cut(t):
    from netloom.operators.ordered import row_numbers

    return graph.sweep_cut(t.h, row_numbers(t.h.vertices.selectExpr("v", "(v * 7919) % 1009 x"), "x", "v", name="rank").select("v", "rank"))


@query("""AND o AS (SELECT v, (v * 7919) % 1009 AS x FROM vertices) SELECT v, row_number() OVER (ORDER BY x, v) AS rank FROM o""")
def eigen_rank(t):
    from netloom.operators.ordered import row_numbers

    return row_numbers(t.h.vertices.selectExpr("v", "(v * 7919) % 1009 x"), "x", "v", name="rank").select("v", "rank")


@query("""AND c AS (SELECT vec_id AS c, embedding AS m FROM embeddings WHERE vec_id < 10),
 d AS (SELECT vec_id AS id, c, list_distance(embedding::DOUBLE[], m::DOUBLE[]) AS d FROM embeddings, c)
 SELECT id, arg_min(c, (d, c)) AS cluster FROM d GROUP BY id""")
def kmeans_assign(t):
    x = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda a: a.cast("double")).alias("x"))
    return graph.kmeans_assign(x, x.where("id < 10").select(F.col("id").alias("c"), "x"))


_SYM = f"{_ARCS}, sym AS (SELECT src, dst, w FROM pa UNION ALL SELECT dst, src, w FROM pa), node AS (SELECT DISTINCT src AS v FROM sym)"


def _sym(t):
    a = _arcs(t)
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


@query(f"""AND {_SYM}, votes AS (SELECT dst AS v, src % 5 AS label, sum(w) AS w FROM sym GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY w DESC, label) AS n FROM votes)
 SELECT v, label FROM r WHERE n = 1""")
def label_propagation_step(t):
    sym = _sym(t)
    return graph.neighbour_mode(sym, sym.select(F.col("src").alias("v")).distinct().selectExpr("v", "v % 5 label"))


@query(f"AND {_SYM} SELECT dst AS v, sum(w * (src % 11))::DOUBLE AS y FROM sym GROUP BY dst")
def graph_filter_step(t):
    sym = _sym(t)
    return graph.spmv(sym, sym.select(F.col("src").alias("v")).distinct().selectExpr("v", "cast(v % 11 as double) x"))


@query(f"AND {_SYM} SELECT dst AS v, round(CASE WHEN dst < 10 THEN dst % 11 ELSE sum(w * (src % 11)) / sum(w) END::DOUBLE, 6) AS x FROM sym GROUP BY dst")
def quadratic_placement_step(t):
    sym = _sym(t)
    x = sym.select(F.col("src").alias("v")).distinct().selectExpr("v", "cast(v % 11 as double) x")
    return graph.jacobi_step(sym, x, x.where("v < 10").select("v")).select("v", F.round("x", 6).alias("x"))


_DAG = """arc AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, max(l_linenumber)::BIGINT AS hi, min(l_linenumber)::BIGINT AS lo FROM lineitem GROUP BY 1, 2
 UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, max(l_linenumber), min(l_linenumber) FROM lineitem GROUP BY 1, 2), node AS (SELECT src AS n FROM arc UNION SELECT dst FROM arc)"""


def _dag(t, late=True):
    delay = (F.max if late else F.min)("l_linenumber").cast("bigint").alias("delay")
    edge = lambda a, b: t.lineitem.groupBy(F.concat(F.lit(a[0]), a[1]).alias("src"), F.concat(F.lit(b[0]), b[1]).alias("dst")).agg(delay)
    arcs = cut_lineage(edge(("s", "l_suppkey"), ("p", "l_partkey")).unionAll(edge(("p", "l_partkey"), ("o", "l_orderkey"))))
    return arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct(), arcs


@query(f"AND {_DAG} SELECT n AS node, CASE substr(n, 1, 1) WHEN 's' THEN 0 WHEN 'p' THEN 1 ELSE 2 END::INT AS level FROM node")
def levelize(t):
    return graph.levelize(*_dag(t))


#: parts of one order are linked if one's class of 8 follows the other's, but not from every class; sources on all levels
_LAYERS = """arc AS (SELECT a.v AS src, b.v AS dst, min((a.v + b.v) % 7 + 1)::BIGINT AS delay FROM pins a JOIN pins b USING (e) WHERE b.v % 8 = a.v % 8 + 1 AND (a.v + b.v) % 3 > 0 GROUP BY 1, 2),
 w AS (SELECT v, v % 8 AS k, 0::BIGINT AS late, 0::BIGINT AS early, 0 AS level FROM vertices WHERE v % 8 = 0
  UNION ALL SELECT x.v, any_value(x.v % 8), coalesce(max(w.late + delay), 0), coalesce(min(w.early + delay), 0), coalesce(max(w.level) + 1, 0) FROM vertices x LEFT JOIN arc ON dst = x.v LEFT JOIN w ON w.v = src
   WHERE x.v % 8 = (SELECT max(k) + 1 FROM w) GROUP BY x.v)"""


def _layers(t):
    p = t.h.pins
    q = p.select("e", F.col("v").alias("u"))
    arcs = p.join(q, "e").where("u % 8 = v % 8 + 1 and (u + v) % 3 > 0").groupBy(F.col("v").alias("src"), F.col("u").alias("dst")).agg(F.min((F.col("v") + F.col("u")) % 7 + 1).alias("delay"))
    return t.h.vertices.select(F.col("v").alias("node")), arcs


@query(f"AND {_LAYERS} SELECT v AS node, level::INT AS level FROM w")
def levelize_layers(t):
    return graph.levelize(*_layers(t))


@query(f"AND {_LAYERS} SELECT v AS node, late AS arrival FROM w")
def arrival_layers(t):
    return graph.propagate(*_layers(t), late=True)


@query(f"""AND {_DAG}, p AS (SELECT dst AS n, max(hi) AS a FROM arc WHERE src LIKE 's%' GROUP BY dst), o AS (SELECT arc.dst AS n, max(p.a + arc.hi) AS a FROM arc JOIN p ON p.n = arc.src GROUP BY arc.dst)
 SELECT n AS node, coalesce(p.a, o.a, 0)::BIGINT AS arrival FROM node LEFT JOIN p USING (n) LEFT JOIN o USING (n)""")
def arrival_late(t):
    return graph.propagate(*_dag(t, True), late=True)


@query(f"""AND {_DAG}, p AS (SELECT dst AS n, min(lo) AS a FROM arc WHERE src LIKE 's%' GROUP BY dst), o AS (SELECT arc.dst AS n, min(p.a + arc.lo) AS a FROM arc JOIN p ON p.n = arc.src GROUP BY arc.dst)
 SELECT n AS node, coalesce(p.a, o.a, 0)::BIGINT AS arrival FROM node LEFT JOIN p USING (n) LEFT JOIN o USING (n)""")
def arrival_early(t):
    return graph.propagate(*_dag(t, False), late=False)


@query(f"""AND {_LAYERS}, late AS (SELECT v, late, early, 40 - late AS slack FROM w WHERE v NOT IN (SELECT src FROM arc)),
 back AS (SELECT v, v % 8 AS k, 40::BIGINT AS required FROM vertices WHERE v % 8 = 7
  UNION ALL SELECT x.v, any_value(x.v % 8), coalesce(min(b.required - delay), 40) FROM vertices x LEFT JOIN arc ON src = x.v LEFT JOIN back b ON b.v = dst WHERE x.v % 8 = (SELECT min(k) - 1 FROM back) GROUP BY x.v)
 SELECT w.v AS node, w.late AS arrival, required, required - w.late AS slack FROM w JOIN back ON back.v = w.v""")
def required_and_slack(t):
    """Late arrival, required time (40 at the ends, less the delays on the way) and slack of every vertex."""
    from netloom.operators import timing

    return timing.slacks(*_layers(t), F.lit(40).cast("bigint"))


@query(f"""AND {_DAG}, h1 AS (SELECT DISTINCT dst AS n FROM arc WHERE src = 's1'), h2 AS (SELECT DISTINCT dst AS n FROM arc WHERE src IN (SELECT n FROM h1))
 SELECT 's1' AS node, 0::INT AS hops UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def reachable(t):
    return graph.reachable(_dag(t)[1], t.spark.sql("SELECT 's1' node"))


@query("""AND hit AS (SELECT e FROM pins JOIN parts2 USING (v) GROUP BY e HAVING min(part) <> max(part) UNION SELECT e FROM pins JOIN other2 USING (v) GROUP BY e HAVING min(part) <> max(part)),
 kept AS (SELECT e, v FROM pins WHERE e NOT IN (SELECT e FROM hit)),
 walk AS (SELECT v, v AS c FROM vertices UNION SELECT b.v, min(w.c) FROM walk w JOIN kept a ON a.v = w.v JOIN kept b ON b.e = a.e GROUP BY b.v) SELECT v, min(c) AS cluster FROM walk GROUP BY v""")
def overlay_clusters(t):
    return coarsen.overlay_clusters(t.h, [t.parts(), t.parts(2, 3)])


@query("""AND tree AS (SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer),
 p AS (SELECT node, node AS root, [node] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, p.root, list_append(p.path, t.node) FROM p JOIN tree t ON t.parent = p.node),
 stops AS (SELECT root, node, path FROM p UNION ALL SELECT p.root, tree.parent, list_append(p.path, 1000000000000) FROM p JOIN tree USING (node) WHERE tree.parent IS NOT NULL)
 SELECT root, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS pos, node FROM stops""")
def euler_tour(t):
    """The tours of the regions' trees of nations and customers."""
    r = t.region.selectExpr("cast(r_regionkey as bigint) node", "cast(null as bigint) parent")
    n = t.nation.selectExpr("cast(n_nationkey + 100 as bigint) node", "cast(n_regionkey as bigint) parent")
    return graph.euler_tour(r.unionAll(n).unionAll(t.customer.selectExpr("cast(c_custkey + 1000 as bigint) node", "cast(c_nationkey + 100 as bigint) parent")))


@query(f"""AND {_WHOLE}, near AS (SELECT b.v, list(DISTINCT a.v) AS less FROM pins a JOIN pins b ON a.e = b.e AND a.v < b.v GROUP BY b.v),
 own AS MATERIALIZED (SELECT v, coalesce(less, []) AS less FROM vertices LEFT JOIN near USING (v)),
 paint AS (SELECT 0::BIGINT AS next, []::BIGINT[] AS colours UNION ALL
  SELECT next + 1, list_append(colours, list_filter(range(0, len(less) + 1), lambda c: NOT list_contains(list_transform(less, lambda u: colours[u + 1]), c))[1]) FROM paint JOIN own ON v = next),
 done AS (SELECT colours FROM paint ORDER BY next DESC LIMIT 1)
 SELECT component, v, colours[v + 1]::INT AS colour FROM comp, done WHERE v IN (SELECT v FROM pins WHERE e IN (SELECT e FROM pins GROUP BY e HAVING count(*) > 1))""")
def greedy_colouring(t):
    wide = t.h.pins.join(t.h.sizes().where("size > 1").select("e"), "e", "left_semi")
    components = graph.connected_components(t.h.vertices, t.h.pins)
    return sequential.greedy_colouring(wide, components=components).join(components, "v").select("component", "v", "colour")


@query(None)
def prim_dijkstra(t):
    nets = t.h.pins.join(t.coords, "v").selectExpr("e net", "v pin", "x", "y").withColumn("driver", F.col("pin") % 5 == 0)
    return graph.prim_dijkstra(nets, 0.4)


@query(None)
def spectral_order(t):
    """The vertices in the order of their first eigenvector, and the cut of every prefix."""
    from netloom.operators.ordered import row_numbers

    x = graph.eigenvectors(t.h, 1)
    order = cut_lineage(row_numbers(x.select("v", "value", "x"), "x", "v", name="rank"))
    return order.join(graph.sweep_cut(t.h, order.select("v", "rank")), "rank")
