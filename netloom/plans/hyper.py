"""Hypergraph queries: degree, incidence, cut, gain, balance, coarsening."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import coarsen, cuts, hypergraph, sequential
from netloom.plans.registry import query


@query("SELECT v, coalesce(n, 0)::BIGINT AS degree FROM vertices LEFT JOIN (SELECT l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1) USING (v)")
def pin_degree(t):
    return hypergraph.pin_degree(t.raw_pins, t.h.vertices)


@query("SELECT v, coalesce(d, 0)::BIGINT AS degree FROM vertices LEFT JOIN (SELECT v, sum(hwt) AS d FROM pins JOIN hyperedges USING (e) GROUP BY v) USING (v)")
def weighted_degree(t):
    return hypergraph.weighted_degree(t.h)


@query("SELECT v, coalesce(edges, []::BIGINT[]) AS edges FROM vertices LEFT JOIN (SELECT v, list(e ORDER BY e) AS edges FROM pins GROUP BY v) USING (v)")
def incidence_list(t):
    return hypergraph.incidence_list(t.h)


@query("AND sizes AS (SELECT e, count(*) AS n FROM pins GROUP BY e) SELECT e, (sum(n) OVER (ORDER BY e) - n + 1)::BIGINT AS first, (sum(n) OVER (ORDER BY e))::BIGINT AS last FROM sizes")
def pair_list(t):
    return hypergraph.pair_list(t.h)


@query("SELECT e, sum(v * v)::BIGINT AS hash FROM pins GROUP BY e")
def hyperedge_hash(t):
    return hypergraph.hyperedge_hash(t.h)


@query("SELECT e FROM epart WHERE lo <> hi")
def cut_edges(t):
    return cuts.cut_edges(t.h, t.parts())


@query("SELECT e, (CASE WHEN lo <> hi THEN -1 ELSE lo END)::INT AS part FROM epart")
def edge_part(t):
    return cuts.edge_part(t.h, t.parts())


@query("SELECT v FROM vertices WHERE v NOT IN (SELECT v FROM pins WHERE e IN (SELECT e FROM epart WHERE lo = hi))")
def nodes_in_cut_only(t):
    return cuts.nodes_in_cut_only(t.h, t.parts())


@query("SELECT v, coalesce(w, 0)::BIGINT AS cut_weight FROM vertices LEFT JOIN (SELECT v, sum(hwt) AS w FROM pins JOIN hyperedges USING (e) WHERE e IN (SELECT e FROM epart WHERE lo <> hi) GROUP BY v) USING (v)")
def incident_cut_weight(t):
    return cuts.incident_cut_weight(t.h, t.parts())


@query("""AND alone AS (SELECT e, part, count(*) AS n, min(v) AS v FROM pins JOIN parts2 USING (v) GROUP BY e, part HAVING count(*) = 1),
 g AS (SELECT v, sum(hwt) AS g FROM alone JOIN hyperedges USING (e) WHERE e IN (SELECT e FROM epart WHERE lo <> hi) GROUP BY v)
 SELECT v, coalesce(g, 0)::BIGINT AS gain FROM vertices LEFT JOIN g USING (v)""")
def move_gain_free(t):
    return cuts.move_gain_free(t.h, t.parts())


@query("""AND cnt AS (SELECT e, part, count(*) AS n FROM pins JOIN parts4 USING (v) GROUP BY e, part), sz AS (SELECT e, sum(n) AS size, count(*) AS spans FROM cnt GROUP BY e),
 own AS (SELECT p.e, p.v, q.part, n, size, spans, hwt FROM pins p JOIN parts4 q USING (v) JOIN cnt ON cnt.e = p.e AND cnt.part = q.part JOIN sz ON sz.e = p.e JOIN hyperedges h ON h.e = p.e),
 lost AS (SELECT v, sum(CASE WHEN spans = 1 AND size > 1 THEN hwt ELSE 0 END) AS lost FROM own GROUP BY v)
 SELECT own.v, cnt.part AS target, (sum(CASE WHEN own.n = 1 AND cnt.n = size - 1 THEN hwt ELSE 0 END) - any_value(lost))::BIGINT AS gain
 FROM own JOIN cnt ON own.e = cnt.e AND own.part <> cnt.part JOIN lost ON lost.v = own.v GROUP BY own.v, cnt.part""")
def kway_gain(t):
    return cuts.kway_gain(t.h, t.parts(4))


@query("SELECT coalesce(sum(hwt), 0)::BIGINT AS cut FROM hyperedges WHERE e IN (SELECT e FROM epart WHERE lo <> hi)")
def cut_size(t):
    return cuts.cut_size(t.h, t.parts())


@query("SELECT sum(CASE WHEN spans > 1 THEN hwt ELSE 0 END)::BIGINT AS cut, sum(hwt * (spans - 1))::BIGINT AS connectivity FROM epart4 JOIN hyperedges USING (e)")
def connectivity_lambda(t):
    return cuts.connectivity(t.h, t.parts(4))


@query("SELECT part, sum(vwt)::BIGINT AS weight, round(sum(vwt) / (SELECT sum(vwt) FROM vertices), 6) AS share FROM vertices JOIN parts2 USING (v) GROUP BY part")
def block_balance(t):
    return cuts.block_balance(t.h, t.parts())


@query("""AND b AS (SELECT part, sum(vwt) AS w FROM vertices JOIN parts2 USING (v) GROUP BY part), a AS (SELECT sum(vwt) AS w FROM vertices)
 SELECT max(b.w)::BIGINT AS max_block, round((100 / 2 + 2) * 0.01 * any_value(a.w)::DOUBLE, 6) AS block_limit, max(b.w) <= (100 / 2 + 2) * 0.01 * any_value(a.w)::DOUBLE AS feasible FROM b, a""")
def balance_feasible(t):
    return cuts.evaluate(t.h, t.parts(), 2, 2).select("max_block", "block_limit", "feasible")


@query("""AND b AS (SELECT part, sum(vwt) AS w FROM vertices JOIN parts2 USING (v) GROUP BY part), a AS (SELECT sum(vwt)::DOUBLE AS w FROM vertices),
 c AS (SELECT coalesce(sum(hwt), 0)::BIGINT AS cut FROM hyperedges WHERE e IN (SELECT e FROM epart WHERE lo <> hi)),
 r AS (SELECT max(b.w)::BIGINT AS max_block, any_value(a.w) AS w FROM b, a)
 SELECT cut, max_block, round(0.6 * w, 6) AS block_limit, max_block <= (100 / 2 + 10) * 0.01 * w AS feasible, CASE WHEN max_block > (100 / 2 + 10) * 0.01 * w THEN 'balance' ELSE 'ok' END AS reason FROM c, r""")
def evaluate_partition(t):
    return cuts.evaluate(t.h, t.parts(), 2, 10)


_OTHER = "o AS (SELECT e FROM pins JOIN other2 USING (v) GROUP BY e HAVING min(part) <> max(part)), c AS (SELECT e FROM epart WHERE lo <> hi)"


@query(f"AND {_OTHER} SELECT (SELECT count(*) FROM c)::BIGINT AS first, (SELECT count(*) FROM o)::BIGINT AS second, (SELECT count(*) FROM (SELECT e FROM c INTERSECT SELECT e FROM o))::BIGINT AS both")
def cut_overlap(t):
    a, b = cuts.cut_edges(t.h, t.parts()), cuts.cut_edges(t.h, t.parts(2, 3))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a, "first").crossJoin(n(b, "second")).crossJoin(n(a.intersect(b), "both"))


@query(f"AND {_OTHER} SELECT e, count(*)::BIGINT AS hits FROM (SELECT e FROM c UNION ALL SELECT e FROM o) GROUP BY e")
def cut_overlay_union(t):
    return cuts.cut_hits(t.h, [t.parts(), t.parts(2, 3)])


@query("""AND ids AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM vertices WHERE fixed IS NOT NULL OR v % 3 <> 0)
 SELECT e, n AS v FROM pins JOIN ids USING (v) WHERE e % 5 <> 0""")
def coarse_filter(t):
    h, _ = coarsen.coarse_filter(t.h, t.h.vertices.where("v % 3 = 0").select("v"), t.h.hyperedges.where("e % 5 = 0").select("e"))
    return h.pins


@query("""AND cp AS (SELECT DISTINCT e, v // 4 AS c FROM pins), l AS (SELECT e, list(c ORDER BY c) AS pins, any_value(hwt) AS hwt FROM cp JOIN hyperedges USING (e) GROUP BY e HAVING count(*) > 1)
 SELECT min(e) AS e, sum(hwt)::BIGINT AS hwt FROM l GROUP BY pins""")
def contract_hypergraph(t):
    return coarsen.contract(t.h, t.h.vertices.selectExpr("v", "v div 4 cluster")).hyperedges


@query("""AND s AS (SELECT e, any_value(hwt) / (count(*) - 1)::DOUBLE AS s FROM pins JOIN hyperedges USING (e) GROUP BY e HAVING count(*) BETWEEN 2 AND 1000)
 SELECT a.v AS v1, b.v AS v2, round(sum(s), 6) AS score FROM pins a JOIN pins b ON a.e = b.e AND a.v < b.v JOIN s ON s.e = a.e GROUP BY 1, 2""")
def heavy_edge_pairs(t):
    return coarsen.heavy_edge_pairs(t.h)


@query("""AND o AS (SELECT v, vwt, row_number() OVER (ORDER BY v) AS rn FROM vertices),
 f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS area, -1::BIGINT AS v, 0 AS part UNION ALL
  SELECT o.rn, CASE WHEN f.area + o.vwt < 5000 THEN f.area + o.vwt ELSE f.area END, o.v, CASE WHEN f.area + o.vwt < 5000 THEN 0 ELSE 1 END FROM f JOIN o ON o.rn = f.rn + 1)
 SELECT v, part::INT AS part FROM f WHERE rn > 0""")
def greedy_fill(t):
    return sequential.first_fit(t.h.vertices, 5000)


@query("""AND a AS (SELECT e, x, y FROM pins JOIN coords USING (v)), m AS (SELECT e, avg(x) AS mx, avg(y) AS my FROM a GROUP BY e),
 d AS (SELECT e, sum(abs(x - mx)) AS dx, sum(abs(y - my)) AS dy FROM a JOIN m USING (e) GROUP BY e) SELECT e, round(sqrt(dx * dx + dy * dy), 6) AS stretch FROM d""")
def hyperstretch(t):
    return hypergraph.hyperstretch(t.h, t.coords).select("e", F.round("stretch", 6).alias("stretch"))


@query("""SELECT e, round(any_value(hwt) * CASE WHEN min(v // 8) = max(v // 8) AND min(v // 4) = max(v // 4) THEN 1.2 WHEN min(v // 8) = max(v // 8) THEN 1.0 ELSE 0.8 END::DOUBLE, 6) AS weight
 FROM pins JOIN hyperedges USING (e) GROUP BY e""")
def net_reweight(t):
    return cuts.net_reweight(t.h, t.h.vertices.selectExpr("v", "v div 8 cluster", "v div 4 sub"))


@query("SELECT e, v FROM pins WHERE e IN (SELECT e FROM pins GROUP BY e HAVING count(*) <= 4)")
def max_fanout_filter(t):
    return hypergraph.max_fanout(t.h, 4).pins


@query("SELECT size, count(*)::BIGINT AS n_edges FROM (SELECT e, count(*)::BIGINT AS size FROM pins GROUP BY e) GROUP BY size")
def fanout_histogram(t):
    return hypergraph.fanout_histogram(t.h)


@query("SELECT 'components' AS what, count(*)::BIGINT AS n FROM part UNION ALL SELECT 'nets', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'connections', count(*) FROM pins UNION ALL SELECT 'terminals', count(*) FROM supplier")
def design_counts(t):
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(t.part, "components").unionAll(n(t.h.hyperedges, "nets")).unionAll(n(t.h.pins, "connections")).unionAll(n(t.supplier, "terminals"))


@query("SELECT pins, list(e ORDER BY e) AS members FROM (SELECT e, list(v ORDER BY v) AS pins FROM pins GROUP BY e) GROUP BY pins HAVING count(*) > 1")
def equiv_classes(t):
    lists = t.h.pins.groupBy("e").agg(F.sort_array(F.collect_list("v")).alias("pins"))
    return lists.groupBy("pins").agg(F.sort_array(F.collect_list("e")).alias("members")).where("size(members) > 1")


@query("SELECT v, ((row_number() OVER (ORDER BY v) - 1) // 64)::BIGINT AS batch FROM vertices WHERE v % 2 = 0")
def solution_batches(t):
    from netloom.operators.ordered import row_numbers

    return row_numbers(t.h.vertices.where("v % 2 = 0").select("v"), "v").select("v", F.expr("(rn - 1) div 64").alias("batch"))
