"""A hierarchy of aggregated graphs as a preconditioner of Laplacians, and their solution by conjugate gradients.

Arcs (src, dst, w) are symmetric, without loops, with positive weights. All levels are tables; only the coarsest one, of
at most `coarsest` vertices, is inverted on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.graph import spmv, tree_levels
from netloom.session import cut_lineage, release

#: share of the neighbours' pull that one smoothing step follows
DAMPING = 2 / 3
#: a round of `solve` takes leaves off the graph while they are at least this share of its vertices
LEAVES = 1 / 4


def heaviest_forest(arcs: DataFrame, spread: float = 4.0) -> DataFrame:
    """(node, parent or null): each vertex below the neighbour of its heaviest arc, of equal ones the least (smaller, larger) pair.

    Of two vertices that choose each other the smaller one is a root. So is a vertex whose weight is `spread` times more
    spread over its arcs (their sum over the heaviest) than the vertices' mean: its heaviest arc says little.
    """
    place = F.struct("w", -F.least("src", "dst"), -F.greatest("src", "dst"))
    near = arcs.groupBy(F.col("src").alias("node")).agg(F.max_by("dst", place).alias("up"), (F.sum("w") / F.max("w")).alias("spread"))
    near = cut_lineage(near)
    mean = near.agg(F.avg("spread").alias("mean"))
    both = near.join(near.select(F.col("node").alias("up"), F.col("up").alias("back")), "up").crossJoin(F.broadcast(mean))  # one row
    root = ((F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))) | (F.col("spread") > spread * F.col("mean"))
    return both.select("node", F.when(~root, F.col("up")).alias("parent"))


def aggregates(arcs: DataFrame, spread: float = 4.0) -> DataFrame:
    """(v, cluster): the trees of `heaviest_forest` cut into stars around their nodes of even level.

    Nodes of odd level join their parent, leaves of even level (but roots) their parent's star. Each star of more than a
    root has two nodes or more, so a level at least halves unless roots stand alone.
    """
    tree = cut_lineage(heaviest_forest(arcs, spread))
    at = tree.join(tree_levels(tree), "node")
    inner = tree.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    at = at.join(inner, "node", "left").join(up, "parent", "left")
    own = F.when(F.col("level") % 2 == 1, F.col("parent")).when(F.col("inner") | (F.col("level") == 0), F.col("node")).otherwise(F.col("above"))
    return at.select(F.col("node").alias("v"), own.alias("cluster"))


@dataclass(frozen=True)
class Level:
    """One graph: its arcs, degrees (v, d) and the clusters (v, cluster) that the next level's vertices are."""

    arcs: DataFrame
    degree: DataFrame
    clusters: DataFrame | None


@dataclass(frozen=True)
class Hierarchy:
    """levels from fine to coarse; inverse (v, u, a) of the coarsest Laplacian, null if that one can't shrink to the bound."""

    levels: list[Level]
    inverse: DataFrame | None

    def apply(self, r: DataFrame, columns: list[str]) -> DataFrame:
        """r (v, columns) -> (v, columns): one V-cycle, nearly the solution of L z = r; symmetric and positive definite.

        Vertices without arcs get 0. Each level is one pass up and one down over its arcs.
        """
        z = self._cycle(0, r.select("v", *columns), columns)
        return r.select("v").join(z, "v", "left").select("v", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])

    def _cycle(self, i: int, r: DataFrame, columns: list[str]) -> DataFrame:
        own = self.levels[i]
        if own.clusters is None and self.inverse is not None:
            far = r.select(F.col("v").alias("u"), *columns)
            return self.inverse.join(far, "u").groupBy("v").agg(*[F.sum(F.col("a") * F.col(c)).alias(c) for c in columns])
        first = lambda c: DAMPING * F.col(c) / F.col("d")
        at = own.degree.join(r, "v")
        z = at.select("v", "d", *[F.col(c).alias(f"r_{c}") for c in columns], *[first(c).alias(c) for c in columns])
        if own.clusters is not None:
            left = _residual(own.arcs, z, columns).join(own.clusters, "v")
            sums = cut_lineage(left.groupBy(F.col("cluster").alias("v")).agg(*[F.sum(c).alias(c) for c in columns]))
            coarse = self._cycle(i + 1, sums, columns).select(F.col("v").alias("cluster"), *[F.col(c).alias(f"e_{c}") for c in columns])
            more = z.join(own.clusters, "v").join(coarse, "cluster", "left")
            z = cut_lineage(more.select("v", "d", *[f"r_{c}" for c in columns], *[(F.col(c) + F.coalesce(f"e_{c}", F.lit(0.0))).alias(c) for c in columns]))
            release(sums)
        left = _residual(own.arcs, z, columns).select("v", *[F.col(c).alias(f"left_{c}") for c in columns])
        return z.join(left, "v").select("v", *[(F.col(c) + DAMPING * F.col(f"left_{c}") / F.col("d")).alias(c) for c in columns])

    def close(self) -> None:
        """Deletes the tables."""
        for level in self.levels:
            release(level.arcs, level.degree, level.clusters)
        release(self.inverse)


def _residual(arcs: DataFrame, z: DataFrame, columns: list[str]) -> DataFrame:
    """(v, columns): r_c - d * c + the neighbours' weighted sum of c, for z (v, d, r_c, c)."""
    pull = arcs.join(z.select(F.col("v").alias("src"), *columns), "src").groupBy(F.col("dst").alias("v"))
    pull = pull.agg(*[F.sum(F.col("w") * F.col(c)).alias(f"p_{c}") for c in columns])
    return z.join(pull, "v", "left").select("v", *[(F.col(f"r_{c}") - F.col("d") * F.col(c) + F.coalesce(f"p_{c}", F.lit(0.0))).alias(c) for c in columns])


def hierarchy(arcs: DataFrame, coarsest: int = 100, spread: float = 4.0) -> Hierarchy:
    """Levels of `aggregates` until at most `coarsest` vertices have arcs, or a level keeps over 0.9 of its vertices.

    In the latter case the last level is only smoothed. Clusters without arcs left (whole components) are dropped.
    """
    if coarsest > 2000:
        raise ValueError(f"coarsest is {coarsest}; its inverse has the square of that many entries")
    levels, before = [], None
    arcs = cut_lineage(arcs.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")))
    while True:
        degree = cut_lineage(arcs.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("d")))
        n = degree.count()
        if n <= coarsest or (before is not None and n > 0.9 * before):
            break
        before = n
        clusters = cut_lineage(aggregates(arcs, spread))
        levels.append(Level(arcs, degree, clusters))
        a = clusters.select(F.col("v").alias("src"), F.col("cluster").alias("a"))
        b = clusters.select(F.col("v").alias("dst"), F.col("cluster").alias("b"))
        arcs = arcs.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        arcs = cut_lineage(arcs)
    levels.append(Level(arcs, degree, None))
    return Hierarchy(levels, cut_lineage(_inverse(arcs)) if n <= coarsest else None)


def _inverse(arcs: DataFrame) -> DataFrame:
    """(v, u, a): the pseudo-inverse of the Laplacian, of at most `coarsest` vertices, so of that many squared arcs."""
    listed = arcs.toPandas()
    ids = np.unique(listed.src.to_numpy())
    n = len(ids)
    m = np.zeros((n, n))
    np.add.at(m, (np.searchsorted(ids, listed.src), np.searchsorted(ids, listed.dst)), -listed.w.to_numpy())
    m -= np.diag(m.sum(axis=1))
    i, j = np.divmod(np.arange(n * n), max(n, 1))
    rows = zip(ids[i].tolist(), ids[j].tolist(), np.linalg.pinv(m, hermitian=True).ravel().tolist(), strict=True) if n else []
    return arcs.sparkSession.createDataFrame(list(rows), "v long, u long, a double")


def _leaves(arcs: DataFrame) -> DataFrame:
    """arcs (src, dst, w), each once in a direction -> (v, up, w): vertices with one neighbour up; of two at one arc the larger."""
    near = arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"), F.max("dst").alias("up"), F.sum("w").alias("w"))
    one = near.where("n = 1").select("v", "up", "w")
    pairs = one.select(F.col("v").alias("up"), F.lit(True).alias("pair"))
    return one.join(pairs, "up", "left").where("pair is null or v > up").select("v", "up", "w")


def _pruned(arcs: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """arcs, loads r (v, r) -> what is left of both when leaves have gone, and the leaves (v, up, rise) of each round.

    The equation of a leaf says x = x of its neighbour + rise, with rise = r / w, so its load goes to the neighbour: exact
    elimination without new arcs. Rounds end when under `LEAVES` of the vertices are leaves, as at the ends of long paths.
    """
    arcs = cut_lineage(arcs.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    gone: list[DataFrame] = []
    while True:
        leaf = cut_lineage(_leaves(arcs))
        n = leaf.count()
        if n == 0 or n < LEAVES * arcs.select("src").distinct().count():
            release(leaf)
            return arcs, r, gone
        own = cut_lineage(leaf.join(r, "v", "left").select("v", "up", "w", F.coalesce("r", F.lit(0.0)).alias("r")))
        off = own.groupBy(F.col("up").alias("v")).agg(F.sum("r").alias("r"))
        left = arcs.join(leaf.select(F.col("v").alias("src")), "src", "left_anti").join(leaf.select(F.col("v").alias("dst")), "dst", "left_anti")
        fewer = cut_lineage(left.select("src", "dst", "w"))
        less = cut_lineage(r.join(leaf.select("v"), "v", "left_anti").select("v", "r").unionByName(off).groupBy("v").agg(F.sum("r").alias("r")))
        gone.append(cut_lineage(own.select("v", "up", (F.col("r") / F.col("w")).alias("rise"))))
        release(arcs, r, leaf, own)
        arcs, r = fewer, less


def solve(arcs: DataFrame, b: DataFrame, tolerance: float = 1e-8, most: int = 200, levels: Hierarchy | None = None, multigrid: bool = True) -> tuple[DataFrame, int]:
    """((v, x), rounds): L x = b by preconditioned conjugate gradients, from 0 on.

    b (v, b) must sum to 0 over each component, and x is only fixed up to a constant on each; vertices without arcs get 0.
    Ends when the residual's norm is under tolerance * the norm of b, or after `most` rounds. `levels` is a hierarchy to
    use again; without one, leaves are eliminated first while they are many, so a graph of bushy trees needs no rounds at all. Without
    `multigrid` residuals are divided by the degrees. Only sums come to the driver.
    """
    arcs = cut_lineage(arcs.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")))
    every = b.select("v").union(arcs.select(F.col("src").alias("v"))).distinct()
    total = lambda t, what: t.agg(F.sum(what)).first()[0] or 0.0
    square: Column = F.col("r") * F.col("r")
    b = cut_lineage(arcs.select(F.col("src").alias("v")).distinct().join(b, "v", "left").select("v", F.coalesce(F.col("b").cast("double"), F.lit(0.0)).alias("r")))
    first = total(b, square)
    rest, r, gone = (arcs, b, []) if levels is not None else _pruned(arcs, b)
    x, rounds = _conjugate(rest, r, first, tolerance, most, levels, multigrid)
    for leaf in reversed(gone):  # x isn't listed for vertices whose arcs have all gone: they are 0
        ups = x.join(leaf.select(F.col("up").alias("v")), "v", "left_semi").select(F.col("v").alias("up"), F.col("x").alias("above"))
        more = leaf.join(ups, "up", "left").select("v", (F.coalesce("above", F.lit(0.0)) + F.col("rise")).alias("x"))
        x = cut_lineage(x.unionByName(more))
    return every.join(x, "v", "left").select("v", F.coalesce("x", F.lit(0.0)).alias("x")), rounds


def _conjugate(arcs: DataFrame, b: DataFrame, first: float, tolerance: float, most: int, levels: Hierarchy | None, multigrid: bool) -> tuple[DataFrame, int]:
    """((v, x), rounds) of `solve` for loads b (v, r) of the vertices with arcs; first is the square of the norm to compare with."""
    if arcs.isEmpty():
        return b.select("v", F.lit(0.0).alias("x")).limit(0), 0
    own = levels or (hierarchy(arcs) if multigrid else None)
    degree = cut_lineage(arcs.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("d")))

    def near(r: DataFrame) -> DataFrame:
        if own is not None:
            return own.apply(r, ["r"]).select("v", F.col("r").alias("z"))
        return r.join(degree, "v").select("v", (F.col("r") / F.col("d")).alias("z"))

    total = lambda t, what: t.agg(F.sum(what)).first()[0] or 0.0
    r = cut_lineage(degree.join(b, "v").select("v", "r"))
    state = written = cut_lineage(r.join(near(r), "v").select("v", F.lit(0.0).alias("x"), "r", F.col("z").alias("p"), "z"))
    release(r)  # each round reads the table that the last one wrote, with its own direction p on top
    square: Column = F.col("r") * F.col("r")
    left, rz, rounds = total(state, square), total(state, F.col("r") * F.col("z")), 0
    while rounds < most and left > tolerance * tolerance * first:
        rounds += 1
        pull = spmv(arcs, state.select("v", F.col("p").alias("x")))
        step = cut_lineage(state.join(degree, "v").join(pull, "v").select("v", "x", "r", "p", (F.col("d") * F.col("p") - F.col("y")).alias("a")))
        release(written)
        alpha = rz / total(step, F.col("p") * F.col("a"))
        moved = cut_lineage(step.select("v", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("a")).alias("r"), "p"))
        release(step)
        written = cut_lineage(moved.join(near(moved.select("v", "r")), "v"))
        release(moved)
        both = written.agg(F.sum(square), F.sum(F.col("r") * F.col("z"))).first()
        left, beta, rz = both[0], both[1] / rz, both[1]
        state = written.withColumn("p", F.col("z") + beta * F.col("p"))
    if levels is None and own is not None:
        own.close()
    return state.select("v", "x"), rounds
