"""Graph and linear-algebra operators over pins (e, v), arcs (src, dst, w) and trees (node, parent)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.hypergraph import Hypergraph
from netloom.operators.ordered import row_numbers
from netloom.session import cut_lineage, dealt, release


def connected_components(vertices: DataFrame, pins: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable. Isolated vertices are components of their own; pins of vertices that aren't listed are left out.

    A hyperedge is a star of arcs to its smallest vertex, so none is expanded to a clique. A round lets each vertex point at the
    smallest one that its arcs name, follows these pointers to their ends by jumps, which shorten chains by half, and
    names the arcs by the ends. Arcs inside of a tree go, equal ones are one. Only the first round reads all pins.
    """
    label = cut_lineage(vertices.select("v", F.col("v").alias("component")))
    known = cut_lineage(pins.select("e", "v").join(label.select("v"), "v", "left_semi"))
    arcs = cut_lineage(known.join(known.groupBy("e").agg(F.min("v").alias("m")), "e").where("v <> m").select("v", "m"))
    release(known)
    while not arcs.isEmpty():
        at = cut_lineage(arcs.groupBy("v").agg(F.min("m").alias("m")))  # a vertex without a row is an end
        while True:
            jump = at.select(F.col("v").alias("m"), F.col("m").alias("far"))
            far = cut_lineage(at.join(jump, "m", "left").select("v", F.coalesce("far", "m").alias("m"), F.col("far").isNotNull().alias("moved")))
            release(at)
            at = far
            if at.where("moved").isEmpty():
                break
        of = lambda c, e: at.select(F.col("v").alias(c), F.col("m").alias(e))
        to = cut_lineage(label.join(of("component", "end"), "component", "left").select("v", F.coalesce("end", "component").alias("component")))
        ends = arcs.join(of("v", "a"), "v").join(of("m", "b"), "m", "left").select("a", F.coalesce("b", "m").alias("b")).where("a <> b")
        rest = cut_lineage(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
        release(label, arcs, at)
        label, arcs = to, rest
    release(arcs)
    return label


def largest_island(components: DataFrame) -> DataFrame:
    """(v, new_v): the vertices of the largest component (of equal ones the least), numbered from 1."""
    best = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return row_numbers(components.join(F.broadcast(best), "component", "left_semi").select("v"), "v", name="new_v")


def cycle_expansion(h: Hypergraph) -> DataFrame:
    """(src, dst, w): 2 pins an arc of the weight, 3 a triangle of half, more a cycle in the order of v; symmetric.

    A cycle of k pins has weight hwt / (2 * mult) with mult = floor(k/2) * ceil(k/2) / (k - 1).
    """
    w = Window.partitionBy("e").orderBy("v")
    all_ = Window.partitionBy("e")
    p = h.pins.select("e", "v", F.count("*").over(all_).alias("k"), F.coalesce(F.lead("v").over(w), F.min("v").over(all_)).alias("to"))
    p = p.where("k > 1").where("k > 2 or v < to").join(h.hyperedges, "e")
    mult = F.floor(F.col("k") / 2) * F.ceil(F.col("k") / 2) / (F.col("k") - 1)
    weight = F.when(F.col("k") == 2, F.col("hwt").cast("double")).when(F.col("k") == 3, F.col("hwt") / 2).otherwise(F.col("hwt") / (2 * mult))
    arcs = p.select(F.col("v").alias("src"), F.col("to").alias("dst"), weight.alias("w"))
    both = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def random_cycles(h: Hypergraph, cycles: int, seed: int = 1) -> DataFrame:
    """(src, dst, w, spread): as `cycle_expansion`, with `cycles` random cycles through the pins of a hyperedge of four and more, of
    weight hwt / (2 * cycles * mult) each. spread is the same expansion with hwt / (largest number of pins) on every arc.

    A cycle's order is that of the MD5 of seed, cycle, hyperedge and vertex, so it is the same in every run.
    """
    pins = cut_lineage(h.pins.select("e", "v"))
    sizes = cut_lineage(pins.groupBy("e").agg(F.count("*").alias("size")).where("size > 1").join(h.hyperedges, "e"))
    whole = sizes.agg(F.max("size").alias("most"), F.sum(F.when(F.col("size") > 3, F.col("size") * cycles).otherwise(F.col("size"))).alias("rows")).first()
    most, rows = whole.most or 1, whole.rows or 0
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 3, cycles).otherwise(1) - 1))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "t", "e", "v"))
    p = dealt(pins, rows, "e").join(dealt(sizes, rows, "e"), "e").withColumn("t", turn).withColumn("key", F.when(F.col("size") > 3, F.unhex(key)).otherwise(F.lit(b"")))
    own = Window.partitionBy("e", "t")
    order = own.orderBy("key", "v")
    k = F.col("size")
    p = p.withColumn("to", F.coalesce(F.lead("v").over(order), F.first("v").over(order))).where("size > 2 or v < `to`")
    mult = F.floor(k / 2) * F.ceil(k / 2) / (k - 1)
    weight = F.when(k == 2, F.col("hwt").cast("double")).when(k == 3, F.col("hwt") / 2).otherwise(F.col("hwt") / (2 * cycles * mult))
    # both directions have the same sums, so each pair is summed once
    arcs = p.select(F.least("v", "to").alias("src"), F.greatest("v", "to").alias("dst"), weight.alias("w"), (F.col("hwt") / F.lit(most)).alias("spread"))
    pair = dealt(arcs, rows, "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("w"), F.sum("spread").alias("spread"))
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return pair.select(ways.alias("a"), "w", "spread").select("a.src", "a.dst", "w", "spread")


def laplacian(h: Hypergraph, x: DataFrame) -> DataFrame:
    """x (v, x) -> (v, y): sum over hyperedges of weight * (x - mean x) / mult, without building cliques.

    Single-pin hyperedges add 0; so do isolated vertices.
    """
    at = h.pins.join(x, "v")
    k = F.col("k")
    edge = at.groupBy("e").agg(F.avg("x").alias("mean"), F.count("*").alias("k")).where("k > 1").join(h.hyperedges, "e")
    edge = edge.select("e", "mean", (F.col("hwt") * (k - 1) / (F.floor(k / 2) * F.ceil(k / 2))).alias("f"))
    y = at.join(edge, "e").groupBy("v").agg(F.sum(F.col("f") * (F.col("x") - F.col("mean"))).alias("y"))
    return h.vertices.select("v").join(y, "v", "left").select("v", F.coalesce("y", F.lit(0.0)).alias("y"))


def clique_matvec(x: DataFrame, mult: float = 1.0) -> DataFrame:
    """x (v, w, x) -> (v, y): weighted clique on all vertices, mult * (w x - (sum w x) w / sum w)."""
    s = x.agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("sw"))
    return x.crossJoin(F.broadcast(s)).select("v", (mult * (F.col("w") * F.col("x") - F.col("wx") * F.col("w") / F.col("sw"))).alias("y"))


def biclique_matvec(x: DataFrame) -> DataFrame:
    """x (v, side in 1, 2 or null, x) -> (v, y): |other side| * x - sum of the other side's x; 0 off both sides."""
    one, two = F.col("side") == 1, F.col("side") == 2
    s = x.agg(*[F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n) for n, c, v in (("n1", one, F.lit(1)), ("n2", two, F.lit(1)), ("x1", one, F.col("x")), ("x2", two, F.col("x")))])
    y = F.when(one, F.col("n2") * F.col("x") - F.col("x2")).when(two, F.col("n1") * F.col("x") - F.col("x1")).otherwise(0)
    return x.crossJoin(F.broadcast(s)).select("v", y.alias("y"))


def constraint_matvec(x: DataFrame, factor: float = 10.0) -> DataFrame:
    """x (v, w, side, x) -> (v, y): the weighted clique plus factor times the bi-clique of the fixed sides."""
    one = clique_matvec(x.select("v", "w", "x")).withColumnRenamed("y", "a")
    two = biclique_matvec(x.select("v", "side", "x")).withColumnRenamed("y", "b")
    return one.join(two, "v").select("v", (F.col("a") + factor * F.col("b")).alias("y"))


def spectral_path_graph(h: Hypergraph, x: DataFrame) -> DataFrame:
    """(src, dst, n): consecutive pins of each hyperedge in the order of x, and how many hyperedges join them."""
    w = Window.partitionBy("e").orderBy("x", "v")
    p = h.pins.join(x, "v").select("v", F.lead("v").over(w).alias("to")).where("`to` is not null")
    return p.groupBy(F.least("v", "to").alias("src"), F.greatest("v", "to").alias("dst")).agg(F.count("*").alias("n"))


def path_lengths(pairs: DataFrame, coordinates: DataFrame, inverse: bool = False, both: bool = False) -> DataFrame:
    """pairs (src, dst, ...), coordinates (v, x array) -> pairs with `length`: the sum over the coordinates of the distances, or of their
    inverses with 1e9 for a distance of 0; `both` adds the latter to the former as `inverse`."""
    at = lambda end: coordinates.select(F.col("v").alias(end), F.col("x").alias(f"{end}_x"))
    gap = lambda a, b: F.abs(a - b)
    total = lambda each: F.aggregate(F.zip_with("src_x", "dst_x", each), F.lit(0.0), lambda s, d: s + d)
    plain, turned = total(gap), total(lambda a, b: F.when(a == b, 1e9).otherwise(1 / gap(a, b)))
    joined = pairs.join(at("src"), "src").join(at("dst"), "dst")
    return joined.select(*pairs.columns, (turned if inverse else plain).alias("length"), *([turned.alias("inverse")] if both else []))


def boruvka_step(arcs: DataFrame, label: DataFrame) -> DataFrame:
    """label (v, component) -> (component, src, dst, w): each component's lightest arc that leaves it, as it is given, ties by src and dst."""
    a = arcs.join(label.select(F.col("v").alias("src"), F.col("component").alias("cs")), "src").join(label.select(F.col("v").alias("dst"), F.col("component").alias("cd")), "dst").where("cs <> cd")
    arc = [F.col("w"), F.col("src").alias("a"), F.col("dst").alias("b")]
    ends = a.select("cs", *arc).unionByName(a.select(F.col("cd").alias("cs"), *arc))
    best = ends.groupBy(F.col("cs").alias("component")).agg(F.min(F.struct("w", "a", "b")).alias("m"))
    return best.select("component", F.col("m.a").alias("src"), F.col("m.b").alias("dst"), F.col("m.w").alias("w"))


def minimum_spanning_forest(vertices: DataFrame, arcs: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, w) by rounds of Boruvka; ties are broken by the ends, so the forest is unique. src is the smaller end; `directed`
    leaves arcs as they are given and breaks ties by src and dst.

    After each round the arcs name the trees of their ends: arcs inside of a tree go, and of those between two trees the
    lightest stays. So trees at least halve and only what still joins different trees is read again. Arcs of vertices
    that aren't listed are left out.
    """
    known = vertices.select("v").distinct()
    own = arcs.join(known.withColumnRenamed("v", "src"), "src", "left_semi").join(known.withColumnRenamed("v", "dst"), "dst", "left_semi").where("src <> dst")
    ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    own = own.select("w", ends[0].alias("a"), ends[1].alias("b"))
    forest, rest = [], cut_lineage(_lightest(own.withColumns({"ca": F.col("a"), "cb": F.col("b")})))
    while True:
        both = F.explode(F.array("ca", "cb")).alias("component")
        best = rest.select(both, "w", "a", "b", "ca", "cb").groupBy("component").agg(F.min(F.struct("w", "a", "b", "ca", "cb")).alias("m"))
        picked = cut_lineage(best.select("m.*").distinct())
        if forest and picked.isEmpty():
            break
        forest.append(picked)
        pins = picked.select(F.struct("ca", "cb").alias("e"), both).withColumnRenamed("component", "v")
        label = connected_components(pins.select("v").distinct(), pins)
        now = rest.join(label.select(F.col("v").alias("ca"), F.col("component").alias("na")), "ca").join(label.select(F.col("v").alias("cb"), F.col("component").alias("nb")), "cb")
        new = cut_lineage(_lightest(now.where("na <> nb").select("w", "a", "b", F.col("na").alias("ca"), F.col("nb").alias("cb"))))
        release(rest)
        rest = new
    release(rest, picked)
    out = forest[0]
    for more in forest[1:]:
        out = out.unionByName(more)
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def _lightest(arcs: DataFrame) -> DataFrame:
    """arcs (w, a, b, ca, cb): the least (w, a, b) between each two of ca and cb, the smaller one as ca."""
    best = arcs.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("m"))
    return best.select("m.*", "ca", "cb")


def _jumps(tree: DataFrame) -> list[DataFrame]:
    """Tables (node, to): the ancestor 1, 2, 4, ... levels up, as long as there is one; raises if the parents hold a cycle.

    One row a node in each. A jump of as many levels as there are nodes can only go round a cycle.
    """
    jump = cut_lineage(tree.where("parent is not null").select("node", F.col("parent").alias("to")))
    out: list[DataFrame] = []
    while not jump.isEmpty():
        if len(out) >= 4 and 1 << len(out) > tree.count():
            raise ValueError("the parents hold a cycle")
        out.append(jump)
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(far, "to").select("node", F.col("far").alias("to")))
    return out


def ancestors(tree: DataFrame) -> DataFrame:
    """tree (node, parent or null) -> (node, anc, up): all ancestors, the node itself at 0, by doubled jumps.

    This has a row for each node and ancestor: for what needs only levels, roots or common ancestors take `tree_levels`,
    `tree_roots` and `lowest_common_ancestors`, which keep one row a node.
    """
    return climbs(tree, tree.select("node"))


def climbs(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """tree (node, parent or null), starts (node) -> (node, anc, up): the ancestors of the starts only, each itself at 0."""
    jumps = _jumps(tree)
    pairs = cut_lineage(starts.select("node", F.col("node").alias("anc"), F.lit(0).alias("up")))
    for level, jump in enumerate(jumps):
        j = jump.select(F.col("node").alias("anc"), "to")
        more = pairs.join(j, "anc").select("node", F.col("to").alias("anc"), (F.col("up") + (1 << level)).alias("up"))
        longer = cut_lineage(pairs.unionByName(more))
        release(pairs)
        pairs = longer
    release(*jumps)
    return pairs


def tree_roots(tree: DataFrame) -> DataFrame:
    """tree (node, parent or null) -> (node, root, level): by pointer jumping, one row a node; raises on a cycle."""
    at = tree.select("node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("int").alias("level"), F.col("parent").isNull().alias("done"))
    at, rounds = cut_lineage(at), 0
    while not at.where("not done").isEmpty():
        rounds += 1
        if rounds > 4 and 1 << (rounds - 1) > tree.count():
            raise ValueError("the parents hold a cycle")
        far = at.select(F.col("node").alias("root"), F.col("root").alias("far"), F.col("level").alias("more"), F.col("done").alias("there"))
        new = at.join(far, "root", "left")  # a parent that is no node is a root
        new = new.select("node", F.coalesce("far", "root").alias("root"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.coalesce("there", F.lit(True)).alias("done"))
        new = cut_lineage(new)
        release(at)
        at = new
    return at.select("node", "root", "level")


def tree_levels(tree: DataFrame) -> DataFrame:
    return tree_roots(tree).select("node", "level")


def lowest_common_ancestors(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> (a, b, lca): both climb to one level and then together, by jumps of falling powers of two.

    One row a pair throughout; null for nodes of different trees and for unknown nodes.
    """
    jumps, place = _jumps(tree), cut_lineage(tree_roots(tree))
    info = lambda c: place.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("level").alias(f"level_{c}"))
    at = pairs.select("a", "b").distinct().join(info("a"), "a").join(info("b"), "b").where("root_a = root_b")
    down, up = F.col("level_a") >= F.col("level_b"), F.col("level_a") < F.col("level_b")
    at = at.select("a", "b", F.when(down, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("y"), F.abs(F.col("level_a") - F.col("level_b")).alias("gap"))
    hop = lambda df, jump, c: df.join(jump.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c, "left")
    for k in range(len(jumps) - 1, -1, -1):
        moved = hop(at, jumps[k], "x")
        far = F.col("gap").bitwiseAND(1 << k) != 0
        at = moved.select("a", "b", F.when(far, F.col("x_to")).otherwise(F.col("x")).alias("x"), "y", "gap")
    at = cut_lineage(at)
    for k in range(len(jumps) - 1, -1, -1):
        moved = hop(hop(at, jumps[k], "x"), jumps[k], "y")
        apart = F.col("x_to") != F.col("y_to")  # null above a root: no move
        at = moved.select("a", "b", *[F.when(apart, F.col(f"{c}_to")).otherwise(F.col(c)).alias(c) for c in ("x", "y")])
    last = hop(at, jumps[0], "x") if jumps else at.withColumn("x_to", F.col("x"))
    found = last.select("a", "b", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("x_to")).alias("lca"))
    return pairs.join(found, ["a", "b"], "left")


def sweep_cut(h: Hypergraph, order: DataFrame) -> DataFrame:
    """order (v, rank from 1) -> (rank, cut): weight cut between the first rank vertices and the rest.

    A hyperedge is cut from its least rank to just before its largest; the running sum of +/- weights gives all
    prefixes at once.
    """
    from netloom.operators.ordered import prefix_sum

    span = h.pins.join(order, "v").groupBy("e").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).join(h.hyperedges, "e")
    delta = span.select(F.col("lo").alias("rank"), "hwt").unionByName(span.select(F.col("hi").alias("rank"), (-F.col("hwt")).alias("hwt")))
    delta = delta.groupBy("rank").agg(F.sum("hwt").alias("d"))
    every = order.select("rank").join(delta, "rank", "left").select("rank", F.coalesce("d", F.lit(0)).alias("d"))
    return prefix_sum(every, "rank", "d").select("rank", F.col("total").alias("cut"))


def kmeans_assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points (id, x array), centroids (c, x array) -> (id, cluster): the nearest centroid, ties to the smaller c.

    The centroids must be few: they are gathered into one array that is broadcast, and each point is scored by
    itself, so no points * centroids rows are made.
    """
    cs = centroids.agg(F.array_sort(F.collect_list(F.struct("c", F.col("x").alias("m")))).alias("cs"))
    gap = lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform("cs", lambda c: F.struct(gap(c["m"]).alias("d"), c["c"].alias("c"))))
    return points.crossJoin(F.broadcast(cs)).select("id", best["c"].alias("cluster"))


def neighbour_mode(arcs: DataFrame, label: DataFrame) -> DataFrame:
    """One label-propagation round: each vertex takes the label of the largest weight around it, ties to the smaller."""
    votes = arcs.join(label.select(F.col("v").alias("src"), "label"), "src").groupBy(F.col("dst").alias("v"), "label").agg(F.sum("w").alias("w"))
    best = votes.groupBy("v").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b"))
    return label.join(best, "v", "left").select("v", F.coalesce(F.col("b.label"), F.col("label")).alias("label"))


def spmv(arcs: DataFrame, x: DataFrame) -> DataFrame:
    """(v, y) = A x for symmetric arcs; vertices without arcs get 0."""
    y = arcs.join(x.select(F.col("v").alias("src"), "x"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    return x.select("v").join(y, "v", "left").select("v", F.coalesce("y", F.lit(0.0)).alias("y"))


def jacobi_step(arcs: DataFrame, x: DataFrame, fixed: DataFrame) -> DataFrame:
    """One step of quadratic placement: free vertices move to the weighted mean of their neighbours."""
    near = arcs.join(x.select(F.col("v").alias("src"), "x"), "src").groupBy(F.col("dst").alias("v")).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    pinned = fixed.select("v", F.lit(True).alias("pinned"))
    out = x.join(near, "v", "left").join(pinned, "v", "left")
    return out.select("v", F.when(F.col("pinned") | F.col("mean").isNull(), F.col("x")).otherwise(F.col("mean")).alias("x"))


def solve_quadratic(arcs: DataFrame, x: DataFrame, fixed: DataFrame, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """(v, x): the places of free vertices where all forces vanish, by conjugate gradients from the given places.

    arcs (src, dst, w) are symmetric. Ends when the forces' norm is under tolerance of the first one, or after `most`
    rounds, each of which is one pass over the arcs; only sums come to the driver. Free vertices without arcs stay.
    """
    arcs = cut_lineage(arcs.select("src", "dst", "w"))
    free = x.join(fixed.select("v"), "v", "left_anti").select("v")
    degree = arcs.groupBy(F.col("dst").alias("v")).agg(F.sum("w").alias("d"))

    def forces(p: DataFrame, name: str) -> DataFrame:
        """(v, name): degree * p less the weighted neighbours, for free vertices."""
        near = spmv(arcs, p.select("v", F.col(name).alias("x")))
        own = p.join(degree, "v", "left").join(near, "v")
        return own.join(free, "v", "left_semi").select("v", (F.coalesce("d", F.lit(0.0)) * F.col(name) - F.col("y")).alias("a"))

    start = x.select("v", "x")
    r = forces(start, "x").select("v", (-F.col("a")).alias("r"))
    state = cut_lineage(start.join(r, "v").select("v", "x", "r", F.col("r").alias("p")))
    first = rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(most):
        if rr <= tolerance * tolerance * first or rr == 0:
            break
        every = x.select("v").join(state.select("v", "p"), "v", "left").select("v", F.coalesce("p", F.lit(0.0)).alias("p"))
        step = cut_lineage(state.join(forces(every, "p"), "v"))
        pap = step.agg(F.sum(F.col("p") * F.col("a"))).first()[0]
        alpha = rr / pap
        moved = cut_lineage(step.select("v", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("a")).alias("r"), "p"))
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        release(state, step)
        state, rr = moved.withColumn("p", F.col("r") + (new / rr) * F.col("p")), new
    return start.join(fixed.select("v"), "v", "left_semi").unionByName(state.select("v", "x"))


def communities(arcs: DataFrame, vertices: DataFrame, method: str = "propagation", rounds: int = 5) -> DataFrame:
    """(v, label) by the named method: `propagation` of labels, each round the heaviest around a vertex; `components`."""
    if method == "components":
        pins = arcs.select(F.struct("src", "dst").alias("e"), F.explode(F.array("src", "dst")).alias("v"))
        return connected_components(vertices.select("v"), pins).withColumnRenamed("component", "label")
    if method != "propagation":
        raise ValueError(f"unknown method {method!r}")
    label = vertices.select("v", F.col("v").alias("label"))
    for _ in range(rounds):
        label = cut_lineage(neighbour_mode(arcs, label))
    return label


def sweep(nodes: DataFrame, arcs: DataFrame, late: bool = True) -> DataFrame:
    """(node, arrival, level) of the nodes that no loop leads to: largest (late) or least sum of delays over paths from
    sources, and the longest path in arcs; arcs (src, dst, delay).

    A node is final once all arcs into it have been counted, that is in the round of its level, so each arc is used in
    one round only. A round writes one table, of the nodes that its arcs or those before have touched and that aren't final yet.
    """
    pick = F.max if late else F.min
    given = hasattr(arcs, "netloom_path")  # a written table is read as it is
    arcs = arcs if given else cut_lineage(arcs.select("src", "dst", "delay"))
    # what waits for how many arcs is a row a node and joins only what a round has touched; arcs are never written with it
    need = cut_lineage(arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")))
    ready = nodes.select("node").join(need.select("node"), "node", "left_anti")
    ready = cut_lineage(ready.select("node", F.lit(0).cast("bigint").alias("arrival"), F.lit(0).alias("level")))
    done, touched, level = ready, None, 0
    while not ready.isEmpty():
        level += 1
        step = arcs.join(ready.select(F.col("node").alias("src"), "arrival"), "src")
        step = step.select(F.col("dst").alias("node"), (F.col("arrival") + F.col("delay")).cast("bigint").alias("arrival"), F.lit(1).cast("bigint").alias("got"))
        if touched is not None:
            step = step.unionByName(touched.where("got < need").select("node", "arrival", "got"))
        step = step.groupBy("node").agg(pick("arrival").alias("arrival"), F.sum("got").alias("got"))
        touched = cut_lineage(step.join(need, "node"))
        ready = touched.where("got = need").select("node", "arrival", F.lit(level).alias("level"))
        done = done.unionByName(ready)
        if level % 20 == 0:
            done = cut_lineage(done)
    release(need, None if given else arcs)
    return done


def levelize(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, level): longest path from a source, in arcs; nodes on or behind a loop have a null level."""
    nodes = cut_lineage(nodes.select("node"))
    done = cut_lineage(sweep(nodes, arcs.select("src", "dst", F.lit(1).alias("delay")).distinct()).select("node", "level"))
    loops = nodes.select("node").join(done, "node", "left_anti").select("node", F.lit(None).cast("int").alias("level"))
    return done.unionByName(loops)


def reachable(arcs: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """start (node) -> (node, hops): what can be reached in at most `most` arcs, with the fewest arcs."""
    arcs = cut_lineage(arcs.select("src", "dst"))
    seen = frontier = cut_lineage(start.select("node", F.lit(0).alias("hops")).distinct())
    hops = 0
    while most is None or hops < most:
        hops += 1
        step = arcs.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hops).alias("hops")))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def propagate(nodes: DataFrame, arcs: DataFrame, late: bool = True) -> DataFrame:
    """(node, arrival): largest (late) or least sum of delays over paths from sources; arcs (src, dst, delay), acyclic.
    A loop raises."""
    nodes = cut_lineage(nodes.select("node"))
    done = cut_lineage(sweep(nodes, arcs, late).select("node", "arrival"))
    if done.count() < nodes.count():
        raise ValueError("the arcs hold a cycle")
    return done


def project(x: DataFrame, of: list[str], weight: str = "w") -> DataFrame:
    """x (v, weight, columns) with each column made orthogonal to the constant under the weights and of unit norm there.

    A column that is constant becomes 0.
    """
    w = F.col(weight)
    mean = x.agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(of)])
    own = x.crossJoin(F.broadcast(mean))  # one row
    own = own.select(*[c for c in x.columns if c not in of], *[(F.col(c) - F.col(f"_s{i}") / F.col("_w")).alias(c) for i, c in enumerate(of)])
    norm = own.agg(*[F.sqrt(F.sum(w * F.col(c) * F.col(c))).alias(f"_n{i}") for i, c in enumerate(of)])
    unit = own.crossJoin(F.broadcast(norm))  # one row
    return unit.select(*[c for c in x.columns if c not in of], *[F.coalesce(F.try_divide(F.col(c), F.col(f"_n{i}")), F.lit(0.0)).alias(c) for i, c in enumerate(of)])


def _laplacians(h: Hypergraph, factor: DataFrame, x: DataFrame, columns: list[str]) -> DataFrame:
    """x (v, columns) -> (v, L of each column), in one pass over the pins; factor (e, f)."""
    at = h.pins.join(factor, "e").join(x.select("v", *columns), "v")
    mean = at.groupBy("e").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    y = at.join(mean, "e").groupBy("v").agg(*[F.sum(F.col("f") * (F.col(c) - F.col(f"_m{i}"))).alias(f"L{c}") for i, c in enumerate(columns)])
    return y


def _parted_vectors(h: Hypergraph, count: int, seed: int) -> DataFrame | None:
    """(k, value, v, x) as of `eigenvectors` for a hypergraph of more than count components, else None: L is 0 on what is constant on each
    component, so hashes of the components, made orthonormal under the weights, are exact. One row a component until the end."""
    part = cut_lineage(connected_components(h.vertices, h.pins))
    xs = [f"x{i}" for i in range(count)]
    noise = [(F.xxhash64("component", F.lit(seed * 1000 + i)) / 2.0**63).alias(c) for i, c in enumerate(xs)]
    weights = h.vertices.select("v", F.greatest(F.col("vwt"), F.lit(1)).cast("double").alias("w"))
    own = cut_lineage(part.join(weights, "v").groupBy("component").agg(F.sum("w").alias("w")).select("component", "w", *noise))
    if own.count() <= count:
        release(part, own)
        return None
    own = cut_lineage(project(own, xs))
    at = [(i, j) for i in range(count) for j in range(i + 1)]
    row = own.agg(*[F.sum(F.col("w") * F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}_{j}") for i, j in at]).first()
    gram = np.zeros((count, count))
    for (i, j), s in zip(at, row, strict=True):
        gram[i, j] = gram[j, i] = s
    turn = np.linalg.inv(np.linalg.cholesky(gram))
    own = cut_lineage(own.select("component", *[sum((float(turn[i, j]) * F.col(xs[j]) for j in range(i + 1)), F.lit(0.0)).alias(xs[i]) for i in range(count)]))
    top = own.agg(*[F.max_by(c, F.struct(F.abs(F.round(c, 9)), -F.col("component"))).alias(c) for c in xs]).first()
    rows = [F.struct(F.lit(i + 1).alias("k"), F.lit(0.0).alias("value"), (F.col(c) * (-1.0 if top[c] < 0 else 1.0)).alias("x")) for i, c in enumerate(xs)]
    return part.join(own, "component").select("v", F.explode(F.array(*rows)).alias("r")).select("r.k", "r.value", "v", "r.x")


def eigenvectors(
    h: Hypergraph, count: int, iterations: int = 40, tolerance: float = 1e-3, seed: int = 1, precondition: Callable[[DataFrame, list[str]], DataFrame] | None = None
) -> DataFrame:
    """(k, value, v, x): the count least eigenpairs of L x = value * W x after the constant one; L is `laplacian`, W the
    vertex weights.

    Preconditioned block iterations (LOBPCG): each applies L once to a block of residuals, divided by L's diagonal or passed
    to `precondition` (as `apply` of a `multigrid.hierarchy` of the cycle expansion), and takes the best vectors in the span of the block, the residuals and the last directions. Only sums of products (a
    matrix of three times count) come to the driver, so the number of vertices isn't limited. Ends after `iterations`
    or when all residuals are under tolerance * value. Signs are fixed: the largest entry, of equal ones that of
    the least v, is positive. Constraint terms on top of W (`clique_matvec`) vanish for vectors orthogonal to the constant.

    With more than `count` components the values are all 0 and the vectors constant on each of them: these are returned without iterations.
    """
    parted = _parted_vectors(h, count, seed)
    if parted is not None:
        return parted
    k = F.col("k")
    factor = h.sizes().withColumnRenamed("size", "k").where("k > 1").join(h.hyperedges, "e")
    factor = cut_lineage(factor.select("e", (F.col("hwt") * (k - 1) / (F.floor(k / 2) * F.ceil(k / 2))).alias("f"), k.alias("k")))
    pins = cut_lineage(h.pins)
    own = Hypergraph(h.vertices, h.hyperedges, pins)
    diagonal = pins.join(factor, "e").groupBy("v").agg(F.sum(F.col("f") * (1 - 1 / F.col("k"))).alias("d"))
    factor = factor.select("e", "f")
    xs, ps, zs = ([f"{c}{i}" for i in range(count)] for c in "xpz")
    noise = [(F.xxhash64("v", F.lit(seed * 1000 + i)) / 2.0**63).alias(c) for i, c in enumerate(xs)]
    x = h.vertices.select("v", F.greatest(F.col("vwt"), F.lit(1)).cast("double").alias("w")).join(diagonal, "v", "left").select("v", "w", F.coalesce("d", F.lit(0.0)).alias("d"), *noise)
    state = cut_lineage(project(x, xs))
    state = state.join(_laplacians(own, factor, state, xs), "v", "left").fillna(0.0)
    state = cut_lineage(state.select("*", *[F.lit(0.0).alias(c) for c in [*ps, *(f"L{p}" for p in ps)]]))
    first, value = True, np.zeros(count)

    def gram(table: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
        sums = [F.sum(F.col(columns[i]) * F.col(f"L{columns[j]}")) for i, j in pairs] + [F.sum(F.col("w") * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]
        row = np.array([x or 0.0 for x in table.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first()])
        a, b = np.zeros((2, len(columns), len(columns)))
        for m, part in ((a, row[: len(pairs)]), (b, row[len(pairs) :])):
            for (i, j), s in zip(pairs, part, strict=True):
                m[i, j] = m[j, i] = s
        return a, b

    for _ in range(iterations):
        a, b = gram(state, xs)
        value = np.diag(a) / np.maximum(np.diag(b), 1e-300)
        residual = [F.col(f"L{c}") - float(value[i]) * F.col("w") * F.col(c) for i, c in enumerate(xs)]
        size = state.agg(*[F.sqrt(F.sum(r * r / F.greatest("w", F.lit(1e-12)))).alias(f"r{i}") for i, r in enumerate(residual)]).first()
        if all((r or 0.0) <= tolerance * max(v, 1e-12) for r, v in zip(size, value, strict=True)):
            break
        if precondition is None:
            z = state.select("*", *[F.coalesce(F.try_divide(r, F.col("d")), F.lit(0.0)).alias(c) for r, c in zip(residual, zs, strict=True)])
        else:
            z = state.join(precondition(state.select("v", *[r.alias(c) for r, c in zip(residual, zs, strict=True)]), zs), "v")
        z = cut_lineage(project(z, zs))
        z = cut_lineage(z.join(_laplacians(own, factor, z, zs), "v", "left").fillna(0.0))
        basis = [*xs, *zs, *([] if first else ps)]
        a, b = gram(z, basis)
        scale, turn = np.linalg.eigh(b)
        good = scale > 1e-12 * scale.max()
        half = turn[:, good] / np.sqrt(scale[good])
        coefficient = (half @ np.linalg.eigh(half.T @ a @ half)[1])[:, :count]
        mixed = lambda names, c, p: sum((float(q) * F.col(f"{p}{n}") for n, q in zip(names, c, strict=True)), F.lit(0.0))
        rest = basis[count:]
        columns = []
        for p in ("", "L"):
            columns += [mixed(basis, coefficient[:, i], p).alias(f"{p}{c}") for i, c in enumerate(xs)]
            columns += [mixed(rest, coefficient[count:, i], p).alias(f"{p}{c}") for i, c in enumerate(ps)]
        new = cut_lineage(z.select("v", "w", "d", *columns))
        release(state, z)
        state, first = new, False
    a, b = gram(state, xs)
    value = np.diag(a) / np.maximum(np.diag(b), 1e-300)
    top = state.agg(*[F.max_by(c, F.struct(F.abs(F.round(c, 9)), -F.col("v"))).alias(c) for c in xs]).first()
    rows = [F.struct(F.lit(i + 1).alias("k"), F.lit(float(value[j])).alias("value"), (F.col(xs[j]) * (-1.0 if (top[j] or 0) < 0 else 1.0)).alias("x")) for i, j in enumerate(np.argsort(value, kind="stable").tolist())]
    return state.select("v", F.explode(F.array(*rows)).alias("r")).select("r.k", "r.value", "v", "r.x")


def eigenvectors_dense(h: Hypergraph, count: int, most: int = 2000) -> DataFrame:
    """(k, value, v, x): the count least eigenpairs of the Laplacian after the constant one, for coarse hypergraphs.

    The matrix of at most `most` vertices is solved in one task; larger ones are for `eigenvectors`. Signs are fixed by
    the first largest entry.
    """
    n = h.vertices.count()
    if n > most:
        raise ValueError(f"{n} vertices are over {most}; use eigenvectors")
    size = Window.partitionBy("e")
    p = h.pins.withColumn("k", F.count("*").over(size)).where("k > 1").join(h.hyperedges, "e")
    rows = h.vertices.select(F.lit(None).cast("bigint").alias("e"), "v", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("hwt")).unionByName(p.select("e", "v", "k", "hwt"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.v[pdf.e.isna()].to_numpy())
        at = {v: i for i, v in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        for _, g in pdf[pdf.e.notna()].groupby("e"):
            i, k = np.array([at[v] for v in g.v]), len(g)
            f = g.hwt.iloc[0] * (k - 1) / ((k // 2) * ((k + 1) // 2))
            m[np.ix_(i, i)] += f * (np.eye(k) - 1 / k)
        value, vec = np.linalg.eigh(m)
        out = []
        for j in range(1, min(count + 1, len(ids))):
            x = vec[:, j] * np.sign(vec[np.abs(vec[:, j]).argmax(), j])
            out.append(pd.DataFrame({"k": j, "value": value[j], "v": ids, "x": x}))
        return pd.concat(out) if out else pd.DataFrame({"k": [], "value": [], "v": [], "x": []})

    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(solve, "k int, value double, v long, x double")


def euler_tour(tree: DataFrame) -> DataFrame:
    """(root, pos, node): the depth-first tour of each tree, kids in the order of their ids; a node stands again after
    each of its kids.

    The tour is a linked list, (node, after its k-th kid) -> next, that is ranked by pointer jumping: the number of
    rounds is the logarithm of the tour's length, and no tree has to fit in a task.
    """
    tree = tree.where("parent is null or parent <> node").select("node", "parent")
    kids = tree.where("parent is not null").withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy("node")))
    kids = cut_lineage(kids.select("node", "parent", "k"))
    roots = tree_roots(tree)
    items = cut_lineage(tree.select("node", F.lit(0).alias("k")).unionByName(kids.select(F.col("parent").alias("node"), "k")))
    down = kids.select(F.col("parent").alias("node"), (F.col("k") - 1).alias("k"), F.col("node").alias("kid"))
    up = kids.select("node", F.col("parent").alias("above"), F.col("k").alias("place"))
    nxt = items.join(down, ["node", "k"], "left").join(up, "node", "left")
    nxt = nxt.select("node", "k", F.coalesce("kid", "above").alias("to"), F.when(F.col("kid").isNotNull(), 0).otherwise(F.col("place")).alias("to_k"))
    at = cut_lineage(nxt.withColumn("left", F.col("to").isNotNull().cast("long")))
    while not at.where("`to` is not null").isEmpty():
        far = at.select(F.col("node").alias("to"), F.col("k").alias("to_k"), F.col("to").alias("far"), F.col("to_k").alias("far_k"), F.col("left").alias("more"))
        new = at.join(far, ["to", "to_k"], "left").select("node", "k", F.col("far").alias("to"), F.col("far_k").alias("to_k"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        new = cut_lineage(new)
        release(at)
        at = new
    size = roots.groupBy("root").agg((2 * F.count("*") - 2).alias("last"))
    return at.join(roots, "node").join(size, "root").select("root", (F.col("last") - F.col("left")).alias("pos"), "node")


def prim_dijkstra(nets: DataFrame, alpha: float, own: DataFrame | None = None) -> DataFrame:
    """nets (net, pin, x, y, driver) -> (net, pin, parent, length, depth): spanning trees from each net's driver.

    own (net, alpha) overrides alpha for some nets, as by fan-out or wirelength.

    The next pin is the one of the least alpha * (path length of its parent) + distance; ties by pin and parent.
    alpha 0 is a minimum spanning tree, 1 a shortest-path tree. Distances are Manhattan. A net's pins are one row
    of the tree step, so filter nets above a fan-out limit first.
    """
    pin = F.struct((~F.col("driver")).alias("o"), "pin", "x", "y")
    rows = nets.groupBy("net").agg(F.array_sort(F.collect_list(pin)).alias("pins"))
    named = own.select("net", "alpha") if own is not None else rows.select("net").limit(0).withColumn("alpha", F.lit(0.0))
    rows = rows.join(named, "net", "left").select("net", "pins", F.coalesce("alpha", F.lit(float(alpha))).alias("alpha"))

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            for net, pins, alpha in zip(pdf.net, pdf.pins, pdf.alpha, strict=True):
                at = [(p["pin"], p["x"], p["y"]) for p in pins]
                rest = {i: (abs(q[1] - at[0][1]) + abs(q[2] - at[0][2]), 0) for i, q in enumerate(at) if i}
                depth = {0: 0.0}
                out.append((net, at[0][0], None, 0.0, 0.0))
                while rest:
                    now = min(rest, key=lambda i: (rest[i][0], i))
                    via = rest.pop(now)[1]
                    length = float(abs(at[now][1] - at[via][1]) + abs(at[now][2] - at[via][2]))
                    depth[now] = depth[via] + length
                    out.append((net, at[now][0], at[via][0], length, depth[now]))
                    for i, (cost, _) in rest.items():
                        new = alpha * depth[now] + abs(at[i][1] - at[now][1]) + abs(at[i][2] - at[now][2])
                        if new < cost:
                            rest[i] = (new, now)
            yield pd.DataFrame(out, columns=["net", "pin", "parent", "length", "depth"]).astype({"parent": "Int64"})

    return rows.mapInPandas(grow, "net long, pin long, parent long, length double, depth double")
