"""k-means under capacities: least-cost assignment of points to a few centres that each take a bounded number.

Points start at their nearest centre, which is the least cost of all. Full centres pass points on along the cheapest
path to a centre with room, where a step from c to d costs the least of (distance to d - distance to c) over the points
at c: successive shortest paths, which stay optimal after each step. What the search needs of a centre is its few
cheapest points for each other centre, so a pass over the points brings LISTED of these for each pair of centres to the
driver; the search goes on until one of these lists runs out and the next pass brings new ones. Points themselves are never gathered.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import cut_lineage, release

LISTED = 256
MAX_CENTRES = 64


def distances(points: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """points (id, x array) -> (id, d array): squared distances to the centres (c, x), in their order."""
    gap = lambda m: F.aggregate(F.zip_with("x", F.array(*map(F.lit, m)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return points.select("id", F.array(*[gap([float(v) for v in x]) for _, x in centres]).alias("d"))


class _Search:
    """Centres 0..k-1 with loads and, for each pair, a heap of (cost, point); rows of d by point."""

    def __init__(self, k: int, load: list[int], capacity: int):
        self.k, self.load, self.capacity = k, load, capacity
        self.at: dict[int, int] = {}
        self.d: dict[int, list[float]] = {}
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(k)] for _ in range(k)]
        self.last: list[list[tuple[float, int] | None]] = [[None] * k for _ in range(k)]  # the dearest one listed, if not all are
        self.moved: dict[int, int] = {}

    def add(self, point: int, c: int, d: list[float]) -> None:
        self.at[point], self.d[point] = c, d
        for to in range(self.k):
            if to != c:
                heapq.heappush(self.heaps[c][to], (d[to] - d[c], point))

    def cheapest(self, c: int, to: int) -> tuple[float, int] | None:
        """None if nobody is there; raises LookupError if the list has run out before the centre has."""
        heap = self.heaps[c][to]
        while heap and self.at[heap[0][1]] != c:
            heapq.heappop(heap)
        last = self.last[c][to]
        if last is not None and (not heap or heap[0] > last):  # one that isn't listed may be cheaper
            raise LookupError
        return heap[0] if heap else None

    def run(self) -> bool:
        """Whether no centre is over its capacity any more; False: new lists are needed."""
        try:
            while any(n > self.capacity for n in self.load):
                self.pass_on()
        except LookupError:
            return False
        return True

    def pass_on(self) -> None:
        step = [[self.cheapest(a, b) if a != b else None for b in range(self.k)] for a in range(self.k)]
        inf = float("inf")
        far = [0.0 if n > self.capacity else inf for n in self.load]
        via = [-1] * self.k
        for _ in range(self.k):
            changed = False
            for a in range(self.k):
                for b in range(self.k):
                    if step[a][b] is not None and far[a] < inf and far[a] + step[a][b][0] < far[b] - 1e-12:
                        far[b], via[b], changed = far[a] + step[a][b][0], a, True
            if not changed:
                break
        to = min((c for c in range(self.k) if self.load[c] < self.capacity), key=lambda c: (far[c], c))
        path = [to]
        while via[path[-1]] >= 0 and len(path) <= self.k:
            path.append(via[path[-1]])
        for b, a in zip(path, path[1:], strict=False):
            point = step[a][b][1]
            self.add(point, b, self.d[point])
            self.moved[point] = b
        self.load[to] += 1
        self.load[path[-1]] -= 1


def assign(points: DataFrame, centres: DataFrame, capacity: int, listed: int = LISTED) -> DataFrame:
    """points (id, x array), centres (c, x array) -> (id, cluster, cost): the assignment of least total cost in which no centre
    has more than capacity points; cost is the squared distance.

    ids are unique. Raises if the points don't fit at all, or for over MAX_CENTRES centres (their matrix of lists is held
    by the driver). Of equal costs the smaller id moves first.
    """
    known = [(r.c, list(r.x)) for r in centres.orderBy("c").limit(MAX_CENTRES + 1).collect()]
    k = len(known)
    if k > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    own = cut_lineage(distances(points, known))
    if own.count() > k * capacity:
        raise ValueError("the points exceed the capacity of all centres")
    nearest = F.array_position("d", F.array_min("d")) - 1
    now = cut_lineage(own.select("id", "d", nearest.cast("int").alias("at")))
    release(own)
    while k:
        load = [0] * k
        for r in now.groupBy("at").count().collect():
            load[r["at"]] = r["count"]
        if max(load) <= capacity:
            break
        search = _Search(k, load, capacity)
        each = now.select("id", "d", "at", F.posexplode(F.transform("d", lambda v: v - F.element_at("d", F.col("at") + 1))).alias("to", "cost")).where("`to` <> at")
        rank = F.row_number().over(Window.partitionBy("at", "to").orderBy("cost", "id"))
        rows = each.withColumn("rn", rank).where(F.col("rn") <= listed).select("id", "d", "at", "to", "cost").collect()  # at most k * k * listed
        for r in {r["id"]: r for r in rows}.values():
            search.add(r["id"], r["at"], list(r["d"]))
        for a in range(k):
            for b in range(k):
                if load[a] > listed and a != b:
                    search.last[a][b] = max((r["cost"], r["id"]) for r in rows if (r["at"], r["to"]) == (a, b))
        search.run()
        if not search.moved:
            raise ValueError("no centre can pass a point on")
        moves = now.sparkSession.createDataFrame(list(search.moved.items()), "id long, new int")
        new = cut_lineage(now.join(F.broadcast(moves), "id", "left").select("id", "d", F.coalesce("new", "at").alias("at")))
        release(now)
        now = new
    names = F.array(*[F.lit(c).cast("long") for c, _ in known])
    return now.select("id", F.element_at(names, F.col("at") + 1).alias("cluster"), F.element_at("d", F.col("at") + 1).alias("cost"))


def kmeans(points: DataFrame, centres: DataFrame, capacity: int, rounds: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, cost), (c, x)): assignments and means in turn until the cost falls by less than tolerance of itself."""
    cost = None
    while True:
        label = assign(points, centres, capacity)
        new = label.agg(F.sum("cost")).first()[0] or 0.0
        rounds -= 1
        if rounds <= 0 or (cost is not None and cost - new <= tolerance * max(cost, 1e-300)):
            return label, centres
        cost = new
        each = points.join(label, "id").select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
        means = each.groupBy(F.col("cluster").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
        centres = cut_lineage(means.unionByName(centres.join(means.select("c"), "c", "left_anti").select("c", "x")))


def silhouette(points: DataFrame, label: DataFrame) -> DataFrame:
    """points (id, x array), label (id, cluster) -> (id, cluster, s): (b - a) / max(a, b) of mean squared distances, a to the others
    of the own cluster, b to the nearest other cluster; 0 alone in a cluster.

    Mean squared distances follow from each cluster's size, sum and sum of squares, so no pairs of points are made.
    The clusters' sums are broadcast: they must be few.
    """
    own = points.join(label.select("id", "cluster"), "id").select("id", "cluster", "x", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("q"))
    each = own.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"))
    sums = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sum"))
    size = own.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    all_ = sums.join(size, "cluster").agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "q", "sum"))).alias("all"))
    dot = lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    total = lambda c: c["n"] * F.col("q") - 2 * dot(c["sum"]) + c["q"]
    rows = own.crossJoin(F.broadcast(all_))  # one row
    mine = F.filter("all", lambda c: c["cluster"] == F.col("cluster"))[0]
    far = F.array_min(F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), lambda c: total(c) / c["n"]))
    out = rows.select("id", "cluster", mine["n"].alias("n"), F.try_divide(total(mine), mine["n"] - 1).alias("a"), far.alias("b"))
    return out.select("id", "cluster", F.when((F.col("n") < 2) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("s"))
