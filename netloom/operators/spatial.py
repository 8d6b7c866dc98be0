"""Wirelength, boxes, grids, density and congestion. Boxes are columns xlo, ylo, xhi, yhi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import cut_lineage, release


def hpwl(pins: DataFrame, coords: DataFrame) -> DataFrame:
    """(e, hpwl): half perimeter of the bounding box of each net's pins."""
    return pins.join(coords, "v").groupBy("e").agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("hpwl"))


def _small_nets(pins: DataFrame, most_pins: int) -> DataFrame:
    return pins.join(pins.groupBy("e").agg(F.count("*").alias("k")).where(f"k <= {most_pins}").select("e"), "e", "left_semi")


def _rest_bounds(at: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """at (e, v, axes) with <axis>lo and <axis>hi, the bounds of the net's pins, and <axis>lo_rest and <axis>hi_rest, those
    of its pins without this one, null if there is no other.

    The second least value comes from a second aggregation of what is above the least, so no net is gathered.
    """
    first = at.groupBy("e").agg(*[f(c).alias(f"{c}{s}") for c in axes for f, s in ((F.min, "lo"), (F.max, "hi"))])
    own = at.join(first, "e")
    second = []
    for c in axes:
        for f, s in ((F.min, "lo"), (F.max, "hi")):
            end = F.col(c) == F.col(f"{c}{s}")
            second += [F.count_if(end).alias(f"{c}{s}_n"), f(F.when(~end, F.col(c))).alias(f"{c}{s}_2")]
    both = own.join(own.groupBy("e").agg(*second), "e")
    alone = lambda c, s: (F.col(c) == F.col(f"{c}{s}")) & (F.col(f"{c}{s}_n") == 1)
    rest = [F.when(alone(c, s), F.col(f"{c}{s}_2")).otherwise(F.col(f"{c}{s}")).alias(f"{c}{s}_rest") for c in axes for s in ("lo", "hi")]
    return both.select("e", "v", *axes, *[f"{c}{s}" for c in axes for s in ("lo", "hi")], *rest)


def hpwl_move_delta(pins: DataFrame, coords: DataFrame, moves: DataFrame, most_pins: int = 1000) -> DataFrame:
    """moves (v, nx, ny) -> (v, delta): change of total wirelength if v alone moves.

    Nets over most_pins don't count: they are the objective's own limit, not one of memory.
    """
    m = _rest_bounds(_small_nets(pins, most_pins).join(coords, "v"), ("x", "y")).join(moves, "v")

    def span(c: str, new: Column) -> Column:  # greatest and least pass over nulls
        return (F.greatest(F.col(f"{c}hi_rest"), new) - F.least(F.col(f"{c}lo_rest"), new)) - (F.col(f"{c}hi") - F.col(f"{c}lo"))

    return m.groupBy("v").agg(F.sum(span("x", F.col("nx")) + span("y", F.col("ny"))).alias("delta"))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    d = before.join(after.select("v", F.col("x").alias("nx"), F.col("y").alias("ny")), "v").select((F.abs(F.col("x") - F.col("nx")) + F.abs(F.col("y") - F.col("ny"))).alias("d"))
    return d.agg(F.sum("d").alias("total"), F.round(F.avg("d"), 6).alias("average"), F.max("d").alias("most"))


def grid_index(x: Column, origin: int, step: int, lines: int) -> Column:
    """Index of the grid cell of x, clamped to the first and last cell."""
    return F.least(F.greatest(F.floor((x - origin) / step), F.lit(0)), F.lit(lines - 1)).cast("bigint")


def grid_lines(patterns: DataFrame) -> DataFrame:
    """patterns (axis, origin, n, step) -> (axis, line): the places of all lines."""
    return patterns.select("axis", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.col("origin") + i * F.col("step"))).alias("line"))


def contains(x: Column, y: Column, bloat: int = 0) -> Column:
    """Whether the box of the row holds the point, grown by bloat on every side."""
    return (x >= F.col("xlo") - bloat) & (x <= F.col("xhi") + bloat) & (y >= F.col("ylo") - bloat) & (y <= F.col("yhi") + bloat)


def contains_3d(x: Column, y: Column, layer: Column, bloat: int = 0) -> Column:
    """The same with layers zlo..zhi of the box, which the bloat doesn't grow."""
    return contains(x, y, bloat) & (layer >= F.col("zlo")) & (layer <= F.col("zhi"))


def overlaps(boxes: DataFrame, cell: int) -> DataFrame:
    """(a, b, area): pairs of boxes of which the inner parts overlap, a < b.

    Boxes are dealt to all grid cells that they touch and joined there; a pair counts in the cell of the lower
    left corner of its common part only, so it comes once without a distinct.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    dealt = boxes.select("*", cells("xlo", "xhi").alias("cx")).select("*", cells("ylo", "yhi").alias("cy"))
    a = dealt.select("cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("v", "xlo", "ylo", "xhi", "yhi")])
    b = dealt.select("cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("v", "xlo", "ylo", "xhi", "yhi")])
    p = a.join(b, ["cx", "cy"]).where("a_v < b_v and a_xlo < b_xhi and b_xlo < a_xhi and a_ylo < b_yhi and b_ylo < a_yhi")
    x, y = F.greatest("a_xlo", "b_xlo"), F.greatest("a_ylo", "b_ylo")
    p = p.where((F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy")))
    area = (F.least("a_xhi", "b_xhi") - x) * (F.least("a_yhi", "b_yhi") - y)
    return p.select(F.col("a_v").alias("a"), F.col("b_v").alias("b"), area.alias("area"))


def tile_shares(boxes: DataFrame, tile: int, value: Column) -> DataFrame:
    """(tx, ty, amount): each box's value spread over the tiles by overlapped area."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile)))
    own = boxes.where("xhi > xlo and yhi > ylo").withColumn("value", value)
    t = own.select("*", span("xlo", "xhi").alias("tx")).select("*", span("ylo", "yhi").alias("ty"))
    common = lambda lo, hi, i: F.least(F.col(hi), (F.col(i) + 1) * tile) - F.greatest(F.col(lo), F.col(i) * tile)
    area = common("xlo", "xhi", "tx") * common("ylo", "yhi", "ty")
    return t.select("tx", "ty", (F.col("value") * area / ((F.col("xhi") - F.col("xlo")) * (F.col("yhi") - F.col("ylo")))).alias("amount"), area.alias("area"))


def rudy(pins: DataFrame, coords: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, rudy): wirelength of each net spread evenly over its box (grown by 1 to hold area), per tile."""
    net = pins.join(coords, "v").groupBy("e").agg(F.min("x").alias("xlo"), F.min("y").alias("ylo"), (F.max("x") + 1).alias("xhi"), (F.max("y") + 1).alias("yhi"))
    shares = tile_shares(net, tile, (F.col("xhi") - F.col("xlo") + F.col("yhi") - F.col("ylo")).cast("double"))
    return shares.groupBy("tx", "ty").agg(F.round(F.sum("amount"), 4).alias("rudy"))


def density(boxes: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, used, density): box area on each tile and its share of the tile."""
    used = tile_shares(boxes, tile, F.lit(1.0)).groupBy("tx", "ty").agg(F.sum("area").alias("used"))
    return used.select("tx", "ty", "used", F.round(F.col("used") / (tile * tile), 6).alias("density"))


def orient(x: Column, y: Column, code: Column) -> tuple[Column, Column]:
    """A point under one of the eight orientations R0 R90 R180 R270 MY MYR90 MX MXR90."""
    table = {"R0": (x, y), "R90": (-y, x), "R180": (-x, -y), "R270": (y, -x), "MY": (-x, y), "MYR90": (-y, -x), "MX": (x, -y), "MXR90": (y, x)}
    out = []
    for i in (0, 1):
        c = F.lit(None)
        for name, both in table.items():
            c = F.when(code == name, both[i]).otherwise(c)
        out.append(c)
    return out[0], out[1]


def instance_box(width: Column, height: Column, x: Column, y: Column, code: Column) -> list[Column]:
    """xlo, ylo, xhi, yhi of a master placed at its lower left corner (x, y): odd quarter turns swap its sides."""
    turned = code.isin("R90", "R270", "MYR90", "MXR90")
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return [x.alias("xlo"), y.alias("ylo"), (x + w).alias("xhi"), (y + h).alias("yhi")]


def polygon_area2(points: DataFrame) -> DataFrame:
    """points (id, pos, x, y) -> (id, area2): twice the signed area, below 0 for clockwise."""
    w, all_ = Window.partitionBy("id").orderBy("pos"), Window.partitionBy("id")
    nx, ny = (F.coalesce(F.lead(c).over(w), F.min_by(c, "pos").over(all_)) for c in ("x", "y"))
    return points.select("id", (F.col("x") * ny - nx * F.col("y")).alias("c")).groupBy("id").agg(F.sum("c").alias("area2"))


def clockwise(points: DataFrame) -> DataFrame:
    """(id, xs, ys): polygons of four points or more, a closing point dropped, turned clockwise."""
    ps = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    last, first = F.element_at("p", -1), F.col("p")[0]
    ps = ps.withColumn("p", F.when((F.size("p") > 1) & (last["x"] == first["x"]) & (last["y"] == first["y"]), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))).where("size(p) >= 4")
    nxt = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    area = F.aggregate(F.zip_with("p", nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0).cast("bigint"), lambda s, c: s + c)
    ps = ps.withColumn("p", F.when(area > 0, F.reverse("p")).otherwise(F.col("p")))
    return ps.select("id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


def optimal_region(pins: DataFrame, coords: DataFrame, axis: str = "x") -> DataFrame:
    """(v, x_lo, x_hi), named by the axis: the median range of x for v: middle two bounds of its nets' boxes without v
    itself. Nets of one pin say nothing."""
    own = _rest_bounds(pins.join(coords, "v"), (axis,)).where(f"{axis}lo_rest is not null")
    b = own.select("v", F.explode(F.array(f"{axis}lo_rest", f"{axis}hi_rest")).alias("b")).groupBy("v").agg(F.sort_array(F.collect_list("b")).alias("b"))
    n = F.size("b")
    return b.select("v", F.element_at("b", (n / 2).cast("int")).alias(f"{axis}_lo"), F.element_at("b", (n / 2).cast("int") + 1).alias(f"{axis}_hi"))


def optimal_regions(pins: DataFrame, coords: DataFrame) -> DataFrame:
    """(v, x_lo, x_hi, y_lo, y_hi): `optimal_region` of both axes, in one pass over the pins."""
    own = _rest_bounds(pins.join(coords, "v"), ("x", "y")).where("xlo_rest is not null and ylo_rest is not null")
    b = own.groupBy("v").agg(*[F.sort_array(F.flatten(F.collect_list(F.array(f"{c}lo_rest", f"{c}hi_rest")))).alias(c) for c in ("x", "y")])
    middle = lambda c, i: F.element_at(c, (F.size(c) / 2).cast("int") + i).alias(f"{c}_{('lo', 'hi')[i]}")
    return b.select("v", *[middle(c, i) for c in ("x", "y") for i in (0, 1)])


def k_nearest(queries: DataFrame, points: DataFrame, k: int, cell: float = 1.0) -> DataFrame:
    """queries (q, x, y), points (id, x, y) -> (q, rank, id, d2): each query's k nearest points by squared distance, ties by id.

    Points of one place are told apart by id only, so k of a place are enough, and queries of one place are looked up once. A round looks at the three times three grid cells around
    a query, which hold all that is nearer than a cell's side; a query whose k-th point is that near is done, the others go
    on with cells of twice the side, until the cells cover everything. So dense places end in small cells, and only
    queries with few points around them see large ones. `cell` is the first side, best so that a cell holds some k points. Rows of null
    coordinates have no neighbours and are none.
    """
    place = Window.partitionBy("x", "y").orderBy("id")
    own = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    own = cut_lineage(own.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n"))
    asked = cut_lineage(queries.select("q", F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy")).where("qx is not null and qy is not null"))
    todo = cut_lineage(asked.select("qx", "qy").distinct())
    ends = own.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = None
    if ends.lox is None:
        return asked.limit(0).select("q", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("d2"))
    far = todo.agg(F.max(F.greatest(F.abs(F.col("qx") - ends.lox), F.abs(F.col("qx") - ends.hix), F.abs(F.col("qy") - ends.loy), F.abs(F.col("qy") - ends.hiy)))).first()[0] or 0.0
    side = float(cell)
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        at = lambda c, s=side: F.floor(F.col(c) / s).cast("long")
        cells = todo.select("qx", "qy", F.explode(near).alias("o")).select("qx", "qy", (at("qx") + F.col("o.a")).alias("cx"), (at("qy") + F.col("o.b")).alias("cy"))
        pairs = cells.join(own.select("id", "x", "y", at("x").alias("cx"), at("y").alias("cy")), ["cx", "cy"])
        d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
        rank = F.row_number().over(Window.partitionBy("qx", "qy").orderBy("d2", "id"))
        best = cut_lineage(pairs.select("qx", "qy", "id", d2.alias("d2")).withColumn("rank", rank).where(F.col("rank") <= k).select("qx", "qy", "rank", "id", "d2"))
        whole = side >= far
        done = best.where((F.col("rank") == k) & (F.col("d2") <= side * side)).select("qx", "qy")
        part = best if whole else best.join(done, ["qx", "qy"], "left_semi")
        out = part if out is None else out.unionByName(part)
        if whole:
            break
        rest = cut_lineage(todo.join(done, ["qx", "qy"], "left_anti"))
        release(todo)
        todo, side = rest, 2 * side
        if todo.isEmpty():
            break
    return asked.join(out, ["qx", "qy"]).select("q", "rank", "id", "d2")


def rectangles(points: DataFrame) -> DataFrame:
    """points (id, pos, x, y) of rectilinear polygons -> (id, xlo, ylo, xhi, yhi): rectangles that cover each polygon without
    overlapping, cut at every height of a corner.

    A slab between two neighbouring heights is crossed by an even number of upright sides; between the first and the second of
    them, the third and the fourth and so on is the inside. Closing points don't matter. A polygon with a side that is neither upright
    nor level raises in the job. One polygon's corners meet in one task.
    """
    order = Window.partitionBy("id").orderBy("pos")
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    sides = points.select("id", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"))
    skew = (F.col("x") != F.col("nx")) & (F.col("y") != F.col("ny"))
    sides = sides.withColumn("y", F.when(skew, F.raise_error(F.concat(F.lit("a side is not rectilinear in polygon "), "id")).cast("bigint")).otherwise(F.col("y")))
    upright = sides.where("x = nx and y <> ny").select("id", "x", F.least("y", "ny").alias("lo"), F.greatest("y", "ny").alias("hi"))
    heights = sides.select("id", F.col("y").alias("ylo")).distinct()
    slabs = heights.withColumn("yhi", F.lead("ylo").over(Window.partitionBy("id").orderBy("ylo"))).where("yhi is not null")
    crossed = slabs.join(upright, "id").where("lo <= ylo and hi >= yhi")
    along = Window.partitionBy("id", "ylo").orderBy("x")
    pairs = crossed.select("id", "ylo", "yhi", F.col("x").alias("xlo"), F.lead("x").over(along).alias("xhi"), F.row_number().over(along).alias("n"))
    return pairs.where("n % 2 = 1 and xhi > xlo").select("id", "xlo", "ylo", "xhi", "yhi")


def swap_candidates(regions: DataFrame, cells: DataFrame, tile: int) -> DataFrame:
    """regions (v, x_lo, x_hi, y_lo, y_hi), cells (v, x, y, width) -> (v, u): the cells u of v's width that stand in v's region, by tiles.

    A cell whose own place is in its region already has no candidates.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    own = regions.join(cells, "v").where("not (x between x_lo and x_hi and y between y_lo and y_hi)").select("v", "width", "x_lo", "x_hi", "y_lo", "y_hi")
    dealt = own.select("*", span("x_lo", "x_hi").alias("tx")).select("*", span("y_lo", "y_hi").alias("ty"))
    there = cells.select(F.col("v").alias("u"), "x", "y", "width", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    return dealt.join(there, ["tx", "ty", "width"]).where("x between x_lo and x_hi and y between y_lo and y_hi and u <> v").select("v", "u")
