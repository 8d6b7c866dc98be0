"""Queries of RC moments, Boolean equivalence, chains of wide cells and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import boolean
from netloom.operators import sequence, spatial, timing
from netloom.plans.registry import query

#: each nation is the driver of a tree of its customers, the suppliers of the nation branch off customers
_NETS = """rc AS (SELECT 'n' || n_nationkey AS node, NULL::VARCHAR AS parent, (n_nationkey % 3)::BIGINT AS r, 1::BIGINT AS c FROM nation
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey >= 25 AND c_custkey % 3 > 0 THEN 'c' || (c_custkey - 25) ELSE 'n' || (c_custkey % 25) END, c_custkey % 4 + 1, c_custkey % 5 FROM customer),
 up AS (SELECT node, node AS anc FROM rc UNION ALL SELECT up.node, rc.parent FROM up JOIN rc ON rc.node = up.anc WHERE rc.parent IS NOT NULL),
 d1 AS (SELECT anc, sum(c) AS d FROM up JOIN rc USING (node) GROUP BY anc), m1 AS (SELECT up.node, -sum(r * d) AS m FROM up JOIN d1 USING (anc) JOIN rc ON rc.node = up.anc GROUP BY up.node),
 d2 AS (SELECT anc, sum(c * m) AS d FROM up JOIN rc USING (node) JOIN m1 USING (node) GROUP BY anc), m2 AS (SELECT up.node, -sum(r * d) AS m FROM up JOIN d2 USING (anc) JOIN rc ON rc.node = up.anc GROUP BY up.node),
 d3 AS (SELECT anc, sum(c * m) AS d FROM up JOIN rc USING (node) JOIN m2 USING (node) GROUP BY anc), m3 AS (SELECT up.node, -sum(r * d) AS m FROM up JOIN d3 USING (anc) JOIN rc ON rc.node = up.anc GROUP BY up.node)"""


def _nets(t):
    n = t.nation.selectExpr("concat('n', n_nationkey) node", "cast(null as string) parent", "cast(n_nationkey % 3 as bigint) r", "1L c")
    parent = "if(c_custkey >= 25 and c_custkey % 3 > 0, concat('c', c_custkey - 25), concat('n', c_custkey % 25))"
    return n.unionAll(t.customer.selectExpr("concat('c', c_custkey)", parent, "cast(c_custkey % 4 + 1 as bigint)", "cast(c_custkey % 5 as bigint)"))


@query(f"AND {_NETS} SELECT node, m1.m::BIGINT AS m1, m2.m::BIGINT AS m2, m3.m::BIGINT AS m3 FROM m1 JOIN m2 USING (node) JOIN m3 USING (node)")
def rc_moments(t):
    return timing.rc_moments(_nets(t)).select("node", "m1", "m2", "m3")


@query(f"""AND {_NETS}, y AS (SELECT split_part(a.anc, '|', 1) AS root, sum(c)::DOUBLE AS y1, sum(c * m1.m)::DOUBLE AS y2, sum(c * m2.m)::DOUBLE AS y3
  FROM up a JOIN rc ON rc.node = a.node JOIN m1 ON m1.node = a.node JOIN m2 ON m2.node = a.node WHERE a.anc LIKE 'n%' GROUP BY 1)
 SELECT root, round(y1 - coalesce(y2 * y2 / nullif(y3, 0), 0), 6) AS c1, round(coalesce(-(y3 * y3) / nullif(y2 * y2 * y2, 0), 0), 6) AS r, round(coalesce(y2 * y2 / nullif(y3, 0), 0), 6) AS c2 FROM y""")
def pi_models(t):
    return timing.pi_models(_nets(t)).select("root", *[F.round(c, 6).alias(c) for c in ("c1", "r", "c2")])


#: eight ways to write functions of three ports, named by the part's key
_FORMS = ["A & B | C", "(A | C) * (B + C)", "!(!(A & B) & C')", "A ^ B", "A & B' | A' & B", "CK & (A | B)", "!(CK' | A' & B')", "CK | A & A' | B"]
_TRUTH = """f AS (SELECT p_partkey AS id, p_partkey % 8 AS form FROM part), bits AS (SELECT a = 1 AS a, b = 1 AS b, c = 1 AS c, k = 1 AS k FROM range(2) x(a), range(2) y(b), range(2) z(c), range(2) w(k)),
 v AS (SELECT form, a, b, c, k, CASE form WHEN 0 THEN (a AND b) OR c WHEN 1 THEN (a OR c) AND (b OR c) WHEN 2 THEN NOT (NOT (a AND b) AND NOT c) WHEN 3 THEN a <> b WHEN 4 THEN (a AND NOT b) OR (NOT a AND b)
   WHEN 5 THEN k AND (a OR b) WHEN 6 THEN NOT (NOT k OR (NOT a AND NOT b)) ELSE k OR (a AND NOT a) OR b END AS y FROM range(8) r(form), bits),
 tt AS (SELECT form, string_agg(y::INT::TEXT, '' ORDER BY a, b, c, k) AS tt FROM v GROUP BY form)"""


def _functions(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("expr"))


@query(f"AND {_TRUTH}, g AS (SELECT tt, min(id) AS first, count(*)::BIGINT AS same FROM f JOIN tt USING (form) GROUP BY tt) SELECT id, first, same FROM f JOIN tt USING (form) JOIN g USING (tt)")
def boolean_equivalence(t):
    """For each function the first one that is equal to it, and how many are."""
    return boolean.equivalent(_functions(t))


@query(f"""AND {_TRUTH}, u AS (SELECT x.form, p FROM v x JOIN v y ON x.form = y.form AND x.y <> y.y CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('CK')) n(p)
  WHERE (x.a <> y.a) = (p = 'A') AND (x.b <> y.b) = (p = 'B') AND (x.c <> y.c) = (p = 'C') AND (x.k <> y.k) = (p = 'CK') GROUP BY 1, 2)
 SELECT id, p AS port FROM f JOIN u USING (form)""")
def boolean_ports(t):
    """The ports that each function depends on."""
    return boolean.function_keys(_functions(t)).select("id", F.explode("ports").alias("port"))


@query(f"""AND {_TRUTH}, h AS (SELECT form, bool_or(y) FILTER (NOT k) AS low_any, bool_and(y) FILTER (k) AS high_all, string_agg(y::INT::TEXT, '' ORDER BY a, b, c) FILTER (k) AS high, string_agg(y::INT::TEXT, '' ORDER BY a, b, c) FILTER (NOT k) AS low FROM v GROUP BY form),
 e AS (SELECT form, CASE WHEN low = high THEN NULL WHEN NOT low_any THEN 'and' WHEN high_all THEN 'or' END AS gate, CASE WHEN NOT low_any THEN high ELSE low END AS rest FROM h),
 s AS (SELECT f.id, gate, rest FROM f JOIN e USING (form) WHERE gate IS NOT NULL) SELECT s.id, gate, m.first FROM s JOIN (SELECT rest, min(id) AS first FROM s GROUP BY rest) m USING (rest)""")
def clock_gates(t):
    """The functions that gate the clock CK, and the first of those with the same enable."""
    keys = boolean.function_keys(_functions(t), "CK").where("gate is not null")
    first = keys.groupBy("enable").agg(F.min("id").alias("first"))
    return keys.join(first, "enable").select("id", "gate", "first")


@query("""AND c AS (SELECT c_custkey AS cell, c_nationkey AS domain, c_custkey % 7 % 4 + 1 AS bits, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, c_custkey) AS rn FROM customer),
 w AS (SELECT cell, domain, rn, bits, 0::BIGINT AS chain, 0::BIGINT AS first_bit FROM c WHERE rn = 1
  UNION ALL SELECT c.cell, c.domain, c.rn, c.bits, CASE WHEN w.first_bit + w.bits + c.bits > 10 THEN chain + 1 ELSE chain END, CASE WHEN w.first_bit + w.bits + c.bits > 10 THEN 0 ELSE w.first_bit + w.bits END
  FROM w JOIN c ON c.domain = w.domain AND c.rn = w.rn + 1)
 SELECT cell, domain, chain, first_bit FROM w""")
def scan_chain_bits(t):
    """Chains of ten bits of cells with one to four."""
    return sequence.scan_chains_of_bits(t.customer.selectExpr("c_nationkey domain", "c_custkey % 3 = 0 falling", "c_custkey cell", "c_custkey % 7 % 4 + 1 bits"), 10)


@query("""AND r AS (SELECT a.v AS q, b.v AS id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE AS d2, row_number() OVER (PARTITION BY a.v ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.v) AS rank
  FROM (SELECT v, v * 37 % 113 AS x, v * v % 71 AS y FROM vertices) a, (SELECT v, v * 37 % 113 AS x, v * v % 71 AS y FROM vertices) b)
 SELECT q, rank::INT AS rank, id, d2 FROM r WHERE rank <= 5""")
def nearest_neighbours(t):
    """The five parts nearest to each part, itself included."""
    p = t.h.vertices.selectExpr("v id", "v * 37 % 113 x", "v * v % 71 y")
    return spatial.k_nearest(p.withColumnRenamed("id", "q"), p, 5, cell=4.0)
