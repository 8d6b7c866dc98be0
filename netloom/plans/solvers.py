"""Queries of aggregated graphs, solved Laplacians and assignments of groups and mirrored pins."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import multigrid, netlist
from netloom.plans.graphs import _SYM, _sym
from netloom.plans.registry import query
from netloom.plans.structure import _FOREST, _forest


@query(f"""AND {_SYM}, near AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, least(src, dst), greatest(src, dst)) AS n, sum(w) OVER (PARTITION BY src) / max(w) OVER (PARTITION BY src)::DOUBLE AS spread FROM sym),
 own AS (SELECT src AS v, dst AS up, spread FROM near WHERE n = 1),
 tree AS (SELECT a.v, CASE WHEN (b.up = a.v AND a.v < a.up) OR a.spread > 4.0::DOUBLE * (SELECT avg(spread) FROM own) THEN NULL ELSE a.up END AS parent FROM own a JOIN own b ON b.v = a.up),
 lev AS (SELECT v, parent, 0 AS level FROM tree WHERE parent IS NULL UNION ALL SELECT tree.v, tree.parent, level + 1 FROM lev JOIN tree ON tree.parent = lev.v)
 SELECT lev.v, CASE WHEN level % 2 = 1 THEN lev.parent WHEN level = 0 OR lev.v IN (SELECT parent FROM tree WHERE parent IS NOT NULL) THEN lev.v ELSE up.parent END AS cluster FROM lev LEFT JOIN tree up ON up.v = lev.parent""")
def graph_aggregates(t):
    """The clusters that make the second level of the hierarchy over parts and suppliers."""
    return multigrid.aggregates(_sym(t))


#: nodes of the forest draw or give node % 7 - 3; each root balances its tree
_LOADS = f"""{_FOREST}, own AS (SELECT node, node % 7 - 3 AS b FROM tree WHERE parent IS NOT NULL)"""


@query(f"""AND {_LOADS}, flow AS (SELECT anc AS node, sum(b) AS flow FROM own JOIN up USING (node) GROUP BY anc)
 SELECT node, round(flow / len::DOUBLE, 4) AS fall FROM flow JOIN tree USING (node) WHERE parent IS NOT NULL""")
def forest_potentials(t):
    """Falls of potential over the edges of the forest, from the solved Laplacian; SQL sums the loads below each edge."""
    v, edges = _forest(t)
    own = edges.selectExpr("dst v", "cast(dst % 7 - 3 as double) b")
    nations = t.nation.selectExpr("cast(n_nationkey + 100 as bigint) v", "cast(n_regionkey as bigint) root")
    roots = nations.union(t.customer.selectExpr("cast(c_custkey + 1000 as bigint) v", "cast(c_nationkey + 100 as bigint) up").join(nations.select(F.col("v").alias("up"), "root"), "up").select("v", "root"))
    balance = own.join(roots, "v").groupBy(F.col("root").alias("v")).agg((-F.sum("b")).alias("b"))
    arcs = edges.union(edges.select("dst", "src", "w"))
    x, _ = multigrid.solve(arcs, own.unionByName(balance), 1e-12)
    high, low = x.select(F.col("v").alias("dst"), F.col("x").alias("high")), x.select(F.col("v").alias("src"), F.col("x").alias("low"))
    return edges.join(high, "dst").join(low, "src").select(F.col("dst").alias("node"), (F.round(F.col("high") - F.col("low"), 4) + 0.0).alias("fall"))


#: suppliers in pairs as groups, parts of a section in order as its slots
_GROUPS = """k AS (SELECT greatest(count(*) // 4, 1) AS k FROM supplier),
 gc AS (SELECT section, grp, slot - place AS start, sum(cost)::BIGINT AS cost, count(*) AS n FROM (SELECT s_suppkey % k AS section, s_suppkey // k // 2 * k + s_suppkey % k AS grp, s_suppkey // k % 2 AS place, p_partkey // k AS slot,
  abs(s_suppkey * 37 % 101 - p_partkey * 53 % 101) AS cost FROM k, supplier JOIN part ON s_suppkey % k = p_partkey % k) GROUP BY 1, 2, 3),
 m AS (SELECT section, grp, max(n) AS n FROM gc GROUP BY 1, 2), c AS (SELECT section, grp, start, cost FROM gc JOIN m USING (section, grp, n) WHERE start >= 0 AND start % (SELECT max(n) FROM m o WHERE o.section = gc.section) = 0)"""


def _best_sums(pin: str, slot: str) -> str:
    """SQL of the least total of each section of c by trying all choices of each row's cheapest columns."""
    return f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, {pin} ORDER BY cost, {slot}) AS r, dense_rank() OVER (PARTITION BY section ORDER BY {pin}) AS i, (SELECT max(n) FROM (SELECT count(DISTINCT {pin}) AS n FROM c GROUP BY section)) AS most FROM c) WHERE r <= most),
 w AS (SELECT section, i, [{slot}] AS used, cost FROM near WHERE i = 1 UNION ALL SELECT w.section, near.i, list_append(used, {slot}), w.cost + near.cost FROM w JOIN near ON near.section = w.section AND near.i = w.i + 1 AND NOT list_contains(used, {slot})),
 full_ AS (SELECT section, max(i) AS n FROM near GROUP BY section)"""


@query(f"AND {_GROUPS}, {_best_sums('grp', 'start')} SELECT w.section, n::BIGINT AS groups, min(cost)::BIGINT AS cost FROM w JOIN full_ ON full_.section = w.section AND w.i = n GROUP BY 1, 2")
def group_assignment(t):
    """The least total cost of each section when pairs of suppliers take neighbouring slots."""
    k = max(t.supplier.count() // 4, 1)
    pins = t.supplier.selectExpr(f"s_suppkey % {k} section", "s_suppkey pin")
    slots = t.part.selectExpr(f"p_partkey % {k} section", f"p_partkey div {k} slot", "p_partkey part")
    costs = pins.join(slots, "section").select("section", "pin", "slot", F.abs(F.col("pin") * 37 % 101 - F.col("part") * 53 % 101).alias("cost"))
    groups = t.supplier.selectExpr("s_suppkey pin", f"s_suppkey div {k} div 2 * {k} + s_suppkey % {k} grp", f"s_suppkey div {k} % 2 place")
    own = netlist.assign_groups(costs.withColumn("cost", F.col("cost").cast("double")), groups)
    return own.join(costs, ["section", "pin", "slot"]).join(groups, "pin").groupBy("section").agg(F.countDistinct("grp").alias("groups"), F.sum("cost").alias("cost"))


#: sections s and s + k lie on opposite edges, as do the slots p and p + k
_MIRRORS = """k AS (SELECT greatest(count(*) // 8, 1) AS k FROM supplier),
 m AS (SELECT s_suppkey AS pin, s_suppkey + k AS mirror FROM supplier, k WHERE s_suppkey % (2 * k) < k AND s_suppkey // (2 * k) % 2 = 0 AND s_suppkey + k IN (SELECT s_suppkey FROM supplier)),
 c AS (SELECT pin % (2 * k) AS section, pin, p_partkey AS slot, (abs(pin * 37 % 101 - p_partkey * 53 % 101) + abs(mirror * 37 % 101 - (p_partkey + k) * 53 % 101))::BIGINT AS cost
  FROM k, m JOIN part ON p_partkey % (2 * k) = pin % (2 * k) AND p_partkey + k IN (SELECT p_partkey FROM part))"""


@query(f"AND {_MIRRORS}, {_best_sums('pin', 'slot')} SELECT w.section, n::BIGINT AS pairs, min(cost)::BIGINT AS cost FROM w JOIN full_ ON full_.section = w.section AND w.i = n GROUP BY 1, 2")
def mirrored_assignment(t):
    """The least total cost of each section's suppliers with their mirrors on the opposite edge."""
    k = max(t.supplier.count() // 8, 1)
    pins = t.supplier.selectExpr(f"s_suppkey % {2 * k} section", "s_suppkey pin")
    slots = t.part.selectExpr(f"p_partkey % {2 * k} section", "p_partkey slot")
    costs = pins.join(slots, "section").select("section", "pin", "slot", F.abs(F.col("pin") * 37 % 101 - F.col("slot") * 53 % 101).alias("cost"))
    mirrors = t.supplier.where(f"s_suppkey % {2 * k} < {k} and s_suppkey div {2 * k} % 2 = 0").selectExpr("s_suppkey pin", f"s_suppkey + {k} mirror")
    mirrors = mirrors.join(t.supplier.selectExpr("s_suppkey mirror"), "mirror", "left_semi")
    opposite = t.part.selectExpr("p_partkey slot", f"if(p_partkey % {2 * k} < {k}, p_partkey + {k}, p_partkey - {k}) other")
    own = netlist.assign_mirrored(costs.withColumn("cost", F.col("cost").cast("double")), mirrors, opposite)
    paid = own.join(costs, ["pin", "slot"]).select("pin", "section", "cost")
    both = mirrors.join(paid, "pin").join(paid.select(F.col("pin").alias("mirror"), F.col("cost").alias("more")), "mirror")
    return both.groupBy("section").agg(F.count("*").alias("pairs"), F.sum(F.col("cost") + F.col("more")).alias("cost"))
