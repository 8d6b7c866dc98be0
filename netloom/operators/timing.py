"""Slack, limits, skew, power and activity queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import cut_lineage


def top_k(paths: DataFrame, group: str, slack: str, k: int, *ties: str) -> DataFrame:
    """The k worst rows of each group; Spark keeps only k rows a group in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(slack, *ties))
    return paths.withColumn("rank", rank).where(F.col("rank") <= k)


def worst_slack(paths: DataFrame) -> DataFrame:
    """(slack, vertex): the least slack and where it is; of equal ones the least vertex."""
    return paths.agg(F.min(F.struct("slack", "vertex")).alias("m")).select("m.slack", "m.vertex")


def wns_tns(paths: DataFrame) -> DataFrame:
    return paths.agg(F.min("slack").alias("wns"), F.sum(F.least("slack", F.lit(0))).alias("tns"))


def slacks(nodes: DataFrame, arcs: DataFrame, at_ends: Column) -> DataFrame:
    """(node, arrival, required, slack) of all nodes: late arrivals, required times from the ends back, their difference.

    at_ends is the required time of nodes without arcs out of them. Required times are early arrivals over the turned arcs,
    so both directions are one pass over the levels.
    """
    from netloom.operators.graph import propagate

    arrival = propagate(nodes, arcs, late=True)
    turned = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("delay")).alias("delay"))
    back = propagate(nodes, turned, late=False).select("node", (at_ends + F.col("arrival")).alias("required"))
    return arrival.join(back, "node").select("node", "arrival", "required", (F.col("required") - F.col("arrival")).alias("slack"))


def worst_corner(slack: DataFrame) -> DataFrame:
    """slack (corner, node, slack) -> (node, corner, slack): the least over corners, of equal ones the first corner."""
    return slack.groupBy("node").agg(F.min(F.struct("slack", "corner")).alias("m")).select("node", "m.corner", "m.slack")


def endpoint_paths(paths: DataFrame, group_count: int, endpoint_count: int, unique_pins: bool = False) -> DataFrame:
    """paths (grp, endpoint, path, slack, pins) -> (grp, endpoint, path, slack, rank): the worst group_count of each group,
    of which an endpoint has at most endpoint_count; unique_pins keeps of paths over the same pins the worst only."""
    own = paths
    if unique_pins:
        best = F.row_number().over(Window.partitionBy("grp", "endpoint", "pins").orderBy("slack", "path"))
        own = own.withColumn("same", best).where("same = 1")
    place = F.row_number().over(Window.partitionBy("grp", "endpoint").orderBy("slack", "path"))
    own = own.withColumn("place", place).where(F.col("place") <= endpoint_count)
    return top_k(own, "grp", "slack", group_count, "path").select("grp", "endpoint", "path", "slack", "rank")


def max_skew_checks(pairs: DataFrame) -> DataFrame:
    """pairs (check_id, clk_at, ref_at, most) -> (check_id, skew, slack, rank): clock less reference arrival, worst slack first."""
    from netloom.operators.ordered import row_numbers

    own = pairs.select("check_id", F.abs(F.col("clk_at") - F.col("ref_at")).alias("skew"), "most").withColumn("slack", F.col("most") - F.col("skew"))
    return row_numbers(own, "slack", "check_id", name="rank").select("check_id", "skew", "slack", "rank")


def limit_violations(values: DataFrame, value: str, pin: Column, port: Column, default: int) -> DataFrame:
    """Rows over the first limit known of pin, port and default, with limit and slack."""
    own = values.withColumn("cap", F.coalesce(pin, port, F.lit(default)))
    return own.withColumn("slack", F.col("cap") - F.col(value)).where("slack < 0")


def power_rollup(power: DataFrame) -> DataFrame:
    """power (grp, internal, switching, leakage) -> the same sums by group with a total row and its share in percent."""
    total = F.sum(F.col("internal") + F.col("switching") + F.col("leakage"))
    r = power.rollup("grp").agg(*[F.sum(c).alias(c) for c in ("internal", "switching", "leakage")], total.alias("total"), F.grouping("grp").alias("whole"))
    all_ = F.max(F.when(F.col("whole") == 1, F.col("total"))).over(Window.partitionBy())
    return r.select(F.when(F.col("whole") == 1, "Total").otherwise(F.col("grp")).alias("grp"), "internal", "switching", "leakage", "total", F.round(100 * F.col("total") / all_, 4).alias("share"))


def min_max_by_edge(arrivals: DataFrame) -> DataFrame:
    """arrivals (pin, edge rise or fall, at) -> one row a pin: least and largest of both edges; null where none is."""
    pick = lambda f, e, n: f(F.when(F.col("edge") == e, F.col("at"))).alias(n)
    return arrivals.groupBy("pin").agg(pick(F.min, "rise", "rise_min"), pick(F.max, "rise", "rise_max"), pick(F.min, "fall", "fall_min"), pick(F.max, "fall", "fall_max"))


def clock_skew(arrivals: DataFrame, launches: DataFrame) -> DataFrame:
    """arrivals (reg, clk, at), launches (src, dst) -> (clk, skew): the largest difference over pairs of one clock."""
    a = arrivals.select(F.col("reg").alias("src"), "clk", F.col("at").alias("ta"))
    b = arrivals.select(F.col("reg").alias("dst"), F.col("clk").alias("clk_b"), F.col("at").alias("tb"))
    return launches.join(a, "src").join(b, "dst").where("clk = clk_b").groupBy("clk").agg(F.max(F.abs(F.col("ta") - F.col("tb"))).alias("skew"))


def constrained_skews(arrivals: DataFrame, launches: DataFrame, latency: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst, launch, capture, skew): arrivals with their clocks' latencies, for the pairs that clock groups allow.

    arrivals (reg, clk, at), launches (src, dst), latency (clk, late; null or none is 0), groups (clk, grp) with one row a
    clock at most. Clocks of different groups are never timed against each other; a clock of none is with all.
    """
    at = arrivals.join(latency, "clk", "left").join(groups, "clk", "left").select("reg", "clk", "grp", (F.col("at") + F.coalesce("late", F.lit(0))).alias("at"))
    a = at.select(F.col("reg").alias("src"), F.col("clk").alias("launch"), F.col("grp").alias("g"), F.col("at").alias("ta"))
    b = at.select(F.col("reg").alias("dst"), F.col("clk").alias("capture"), F.col("grp").alias("h"), F.col("at").alias("tb"))
    pairs = launches.join(a, "src").join(b, "dst").where("launch = capture or g is null or h is null or g = h")
    return pairs.select("src", "dst", "launch", "capture", (F.col("ta") - F.col("tb")).alias("skew"))


def path_arrival(stages: DataFrame) -> DataFrame:
    """stages (path, pos, delay) -> with arrival, the running sum along each path."""
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return stages.select("path", "pos", F.sum("delay").over(w).alias("arrival"))


def derate(arcs: DataFrame, cell: DataFrame, net: DataFrame, default: float) -> DataFrame:
    """arcs (id, cell, net) -> (id, factor): the cell's factor, else the net's, else the default."""
    out = arcs.join(cell.withColumnRenamed("factor", "fc"), "cell", "left").join(net.withColumnRenamed("factor", "fn"), "net", "left")
    return out.select("id", F.coalesce("fc", "fn", F.lit(default)).alias("factor"))


def elmore(tree: DataFrame) -> DataFrame:
    """tree (node, parent, r, c) -> (node, delay): sum over the nodes on its path of r times the capacitance below. One row a node."""
    return rc_moments(tree, 1).select("node", (-F.col("m1")).alias("delay"))


def rc_moments(tree: DataFrame, count: int = 3) -> DataFrame:
    """tree (node, parent, r, c), r from the parent (of the root: of its driver) -> (node, root, c, m1, ..., m_count): the moments of the
    voltage at each node for a step at the driver.

    m_j = -(sum over the nodes on the path of r times the summed c * m_(j-1) below), m_0 = 1: a sum over subtrees
    and one over root paths for each moment, both prefix sums in preorder.
    """
    from netloom.operators import trees

    order = trees.rooted_order(tree.select("node", "parent"))
    at = cut_lineage(tree.select("node", "r", "c"))
    moment = None
    for j in range(1, count + 1):
        charge = at.select("node", F.col("c").alias("x")) if moment is None else at.join(moment, "node").select("node", (F.col("c") * F.col(f"m{j - 1}")).alias("x"))
        drop = trees.subtree_sums(order, charge).join(at, "node").select("node", (F.col("below") * F.col("r")).alias("length"))
        new = trees.root_distances(order, drop).select("node", (-F.col("distance")).alias(f"m{j}"))
        moment = cut_lineage(new if moment is None else moment.join(new, "node"))
    return order.select("node", "root").join(at.select("node", "c"), "node").join(moment, "node")


def pi_models(tree: DataFrame) -> DataFrame:
    """tree (node, parent, r, c) -> (root, c1, r, c2): for each tree the capacitance at the driver, the resistance and the capacitance behind
    it that have the first three moments of the tree's admittance.

    With y1 = sum c, y2 = sum c * m1, y3 = sum c * m2: c2 = y2^2 / y3, r = -y3^2 / y2^3, c1 = y1 - c2. A tree without any
    resistance in front of a capacitance is c1 alone.
    """
    y = rc_moments(tree, 2).groupBy("root").agg(F.sum("c").cast("double").alias("y1"), F.sum(F.col("c") * F.col("m1")).cast("double").alias("y2"), F.sum(F.col("c") * F.col("m2")).cast("double").alias("y3"))
    far = F.coalesce(F.try_divide(F.col("y2") * F.col("y2"), "y3"), F.lit(0.0))
    return y.select("root", (F.col("y1") - far).alias("c1"), F.coalesce(-F.try_divide(F.col("y3") * F.col("y3"), F.col("y2") * F.col("y2") * F.col("y2")), F.lit(0.0)).alias("r"), far.alias("c2"))


def activity(waves: DataFrame, active: str) -> DataFrame:
    """waves (id, t in microseconds, value) -> (id, toggles, duty): value changes and the share of time at `active`."""
    w = Window.partitionBy("id").orderBy("t", "value")
    own = waves.select("id", "t", "value", F.lag("value").over(w).alias("before"), F.lead("t").over(w).alias("until"))
    held = F.col("until") - F.col("t")
    return own.groupBy("id").agg(
        F.count_if(F.col("before") != F.col("value")).alias("toggles"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("value") == active, held)), F.sum(held)), F.lit(0.0)), 6).alias("duty"),
    )


def smallest_positive_gap(launch: DataFrame, capture: DataFrame) -> DataFrame:
    """launch and capture (clk, period, offset), few rows -> (src, dst, gap): least capture - launch distance above 0.

    Edges repeat over the common period, which is the product of both periods at most.
    """
    a = launch.select(F.col("clk").alias("src"), F.col("period").alias("pa"), F.col("offset").alias("oa"))
    b = capture.select(F.col("clk").alias("dst"), F.col("period").alias("pb"), F.col("offset").alias("ob"))
    pairs = a.crossJoin(b)  # clocks, not data rows
    e = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pb") - 1)).alias("i"))
    gap = F.pmod(F.col("ob") - F.col("oa") - F.col("i") * F.col("pa"), F.col("pb"))
    return e.select("src", "dst", F.when(gap == 0, F.col("pb")).otherwise(gap).alias("gap")).groupBy("src", "dst").agg(F.min("gap").alias("gap"))
