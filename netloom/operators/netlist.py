"""Netlist queries and edits: registers, clocks, swaps, parasitics, properties, legalisation, assignment, packing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import cut_lineage, release


def registers(insts: DataFrame, pins: DataFrame, clock: str | None = None, edge: str | None = None) -> DataFrame:
    """insts (inst, sequential), pins (inst, pin, kind, clock, edge) -> data, clk, async and output pins of registers."""
    own = pins.join(insts.where("sequential").select("inst"), "inst", "left_semi")
    clk = own.where("kind = 'clk'")
    if clock is not None:
        clk = clk.where(F.col("clock") == clock)
    if edge is not None:
        clk = clk.where(F.col("edge") == edge)
    return own.join(clk.select("inst").distinct(), "inst", "left_semi").select("inst", "pin", "kind")


#: clocks of a row of `clock_nets` are bits of so many 64-bit words
CLOCK_WORDS = 4
#: such rows of a task that makes the pairs
CLOCK_ROWS = 1 << 17


def clock_nets(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """sources (clock, node), arcs (src, dst) -> (clock, node): what each clock reaches, all clocks in one search.

    Clocks are numbered, and a node has a row for each 256 of them of which one reaches it, with a bit for each. So arcs pass on
    rows of clocks, and the pairs themselves are only made of the result's rows.
    """
    from netloom.operators.ordered import row_numbers

    arcs = cut_lineage(arcs.select("src", "dst"))
    words, most = [f"w{i}" for i in range(CLOCK_WORDS)], 64 * CLOCK_WORDS
    sources = cut_lineage(sources.select("clock", "node").where("clock is not null and node is not null").distinct())
    number = cut_lineage(row_numbers(sources.select("clock").distinct(), "clock", name="n").select("clock", (F.col("n") - 1).alias("n"), F.expr(f"(n - 1) div {most}").alias("piece")))
    bit = F.expr("shiftleft(1L, cast(n % 64 as int))")
    own = [F.when(F.expr(f"n div 64 % {CLOCK_WORDS}") == i, bit).otherwise(F.lit(0)).alias(w) for i, w in enumerate(words)]
    fresh = sources.join(number, "clock").select("node", "piece", *own).groupBy("node", "piece").agg(*[F.bit_or(w).alias(w) for w in words])
    fresh = cut_lineage(fresh)
    seen = fresh
    while True:
        step = arcs.join(fresh.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "piece", *words, *[F.lit(0).cast("long").alias(f"old_{w}") for w in words])
        known = seen.select("node", "piece", *[F.lit(0).cast("long").alias(w) for w in words], *[F.col(w).alias(f"old_{w}") for w in words])
        both = step.unionByName(known).groupBy("node", "piece").agg(*[F.bit_or(c).alias(c) for w in words for c in (w, f"old_{w}")])
        new = both.select("node", "piece", *[F.col(w).bitwiseAND(F.bitwise_not(F.col(f"old_{w}"))).alias(w) for w in words])
        fresh = cut_lineage(new.where(" or ".join(f"{w} <> 0" for w in words)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    release(arcs, sources, fresh)
    names = number.groupBy(F.expr("n div 64").alias("word")).agg(F.collect_list(F.struct((F.col("n") % 64).cast("int").alias("bit"), "clock")).alias("clocks"))  # at most 64
    # few bytes make many rows: dealt to tasks by their number
    rows = seen.repartition(seen.count() // CLOCK_ROWS + 1)
    word = F.explode(F.array(*[F.struct((F.col("piece") * CLOCK_WORDS + i).alias("word"), F.col(w).alias("bits")) for i, w in enumerate(words)]))
    own = rows.select("node", word.alias("w")).where("w.bits <> 0").select("node", "w.word", "w.bits").join(names, "word")
    return own.select(F.explode(F.filter("clocks", lambda c: F.getbit("bits", c["bit"]) == 1)["clock"]).alias("clock"), "node")


def common_path_credit(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """tree (node, parent, late, early), pairs (a, b) -> (a, b, pin, credit): late - early at the last shared clock pin."""
    from netloom.operators.graph import lowest_common_ancestors

    lca = lowest_common_ancestors(tree.select("node", "parent"), pairs)
    at = tree.select(F.col("node").alias("lca"), (F.col("late") - F.col("early")).alias("credit"))
    return lca.join(at, "lca", "left").select("a", "b", F.col("lca").alias("pin"), F.coalesce("credit", F.lit(0)).alias("credit"))


def swappable(terms: DataFrame, swaps: DataFrame) -> DataFrame:
    """terms (master, term), swaps (inst, old, new) -> (inst, ok): whether both masters have the same terminal names."""
    names = terms.groupBy("master").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    out = swaps.join(names.select(F.col("master").alias("old"), F.col("terms").alias("a")), "old", "left").join(names.select(F.col("master").alias("new"), F.col("terms").alias("b")), "new", "left")
    return out.select("inst", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))


def property_table(properties: DataFrame, names: list[str]) -> DataFrame:
    """properties (owner, name, value) -> one row an owner, a column for each of names."""
    return properties.groupBy("owner").pivot("name", names).agg(F.max("value"))


def pattern_members(groups: DataFrame, insts: DataFrame) -> DataFrame:
    """groups (grp, pattern), few, with * and ? -> (grp, inst): the instances that a group's pattern fits."""
    p = F.replace(F.replace(F.replace(F.replace(F.replace("pattern", F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%")), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    return insts.join(F.broadcast(groups.withColumn("p", p)), F.expr("inst like p")).select("grp", "inst")


def stacked_via_nets(segments: DataFrame, ports: DataFrame) -> DataFrame:
    """segments (net, x1, y1, l1, x2, y2, l2), ports (net, layer) -> (net, stacked): no wires, and the via places are
    no more than the ports on the nets' lowest layer or above."""
    via = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    own = segments.groupBy("net").agg(F.count_if(~via).alias("wires"), F.count_distinct(F.when(via, F.struct("x1", "y1"))).alias("places"), F.min(F.least("l1", "l2")).alias("low"))
    n = own.join(ports, "net", "left").groupBy("net", "wires", "places").agg(F.count_if(F.col("layer") >= F.col("low")).alias("ports"))
    return n.select("net", ((F.col("wires") == 0) & (F.col("places") <= F.col("ports"))).alias("stacked"))


def shift_legalise(cells: DataFrame) -> DataFrame:
    """cells (row, cell, x, width) -> (row, cell, x): in each row cells keep their order of x and don't overlap.

    Neighbours that collide form a clump at the mean of its cells' wishes, which is the least sum of squared
    shifts. One row is one task's group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "cell"], ignore_index=True)
        clumps: list[list[float]] = []  # wish of the left end, weight, width, first cell
        for i, (x, w) in enumerate(zip(pdf.x.astype(float), pdf.width.astype(float), strict=True)):
            clumps.append([x, 1.0, w, i])
            while len(clumps) > 1 and clumps[-2][0] + clumps[-2][2] > clumps[-1][0]:
                b, a = clumps.pop(), clumps.pop()
                clumps.append([(a[0] * a[1] + (b[0] - a[2]) * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2], a[3]])
        out = np.zeros(len(pdf))
        ends = [c[3] for c in clumps[1:]] + [len(pdf)]
        for c, end in zip(clumps, ends, strict=True):
            at = c[0]
            for i in range(int(c[3]), int(end)):
                out[i] = at
                at += pdf.width.iloc[i]
        return pd.DataFrame({"row": pdf.row, "cell": pdf.cell, "x": out})

    return cells.groupBy("row").applyInPandas(run, "row long, cell long, x double")


def reorder_windows(cells: DataFrame, size: int = 3) -> DataFrame:
    """cells (row, cell, x, width, wish) -> (row, window, place, cell): in windows of size cells, in the order of x, the
    order of the least summed distance of places from wishes; ties to the earlier order.

    size is small: all its orders are tried inside one expression for each window.
    """
    w = Window.partitionBy("row").orderBy("x", "cell")
    rn = F.row_number().over(w) - 1
    own = cells.withColumn("window", F.floor(rn / size)).groupBy("row", "window").agg(F.array_sort(F.collect_list(F.struct("x", "cell", "width", "wish"))).alias("c"))
    left = F.array_min(F.transform("c", lambda k: k["x"]))

    def cost(order: tuple[int, ...]) -> Column:
        at, total = left, F.lit(0)
        for i in order:
            k = F.col("c")[i]
            total = total + F.abs(at - k["wish"])
            at = at + k["width"]
        return F.struct(total.cast("double").alias("cost"), F.lit(n).alias("n"), F.array(*[F.col("c")[i]["cell"] for i in order]).alias("cells"))

    best = F.lit(None)
    for held in range(1, size + 1):
        tried = []
        for n, order in enumerate(permutations(range(held))):
            tried.append(cost(order))
        best = F.when(F.size("c") == held, F.array_min(F.array(*tried))["cells"]).otherwise(best)
    return own.select("row", "window", F.posexplode(best).alias("place", "cell"))


def assign(costs: DataFrame) -> DataFrame:
    """costs (section, pin, slot, cost) -> (section, pin, slot): a least-cost assignment in each section (Hungarian method).

    Every pin gets a slot of its own; a section of more pins than slots raises, as does one where the given pairs can't
    serve all pins. One section is one task's group, so sections must be bounded.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="pin", columns="slot", values="cost").sort_index().sort_index(axis=1)
        a = m.fillna(1e18).to_numpy(float)
        n, k = a.shape
        if n > k:
            raise ValueError(f"{n} pins, {k} slots")
        u, v, of, way = np.zeros(n + 1), np.zeros(k + 1), np.zeros(k + 1, int), np.zeros(k + 1, int)
        for i in range(1, n + 1):
            of[0], j = i, 0
            least, used = np.full(k + 1, np.inf), np.zeros(k + 1, bool)
            while of[j]:
                used[j] = True
                free = ~used[1:]
                now = a[of[j] - 1] - u[of[j]] - v[1:]
                better = free & (now < least[1:])
                least[1:][better], way[1:][better] = now[better], j
                rest = np.where(free, least[1:], np.inf)
                nxt = int(rest.argmin()) + 1
                step = rest[nxt - 1]
                u[of[used]] += step
                v[used] -= step
                least[1:][free] -= step
                j = nxt
            while j:
                of[j] = of[way[j]]
                j = way[j]
        slots = [j for i in range(1, n + 1) for j in range(1, k + 1) if of[j] == i]
        if any(a[i, j - 1] >= 1e18 for i, j in enumerate(slots)):
            raise ValueError("the pairs given don't serve all pins")
        return pd.DataFrame({"section": pdf.section.iloc[0], "pin": m.index, "slot": [m.columns[j - 1] for j in slots]})

    return costs.groupBy("section").applyInPandas(solve, "section long, pin long, slot long")


def group_costs(costs: DataFrame, groups: DataFrame) -> DataFrame:
    """costs (section, pin, slot, cost), groups (pin, grp, place from 0 on) -> (section, grp, slot, cost): what a group costs from a slot on.

    A group's pins take consecutive slots in the order of their places. It may start at slots that are multiples of its
    section's largest group, so that no two groups overlap; starts that lack a slot or a price for one pin are left out.
    """
    of = costs.join(groups, "pin")
    members = of.select("section", "grp", "pin").distinct().groupBy("section", "grp").agg(F.count("*").alias("members"))
    largest = members.groupBy("section").agg(F.max("members").alias("largest"))
    at = of.withColumn("start", F.col("slot") - F.col("place")).join(largest, "section").where("start >= 0 and start % largest = 0")
    whole = at.groupBy("section", "grp", "start").agg(F.sum("cost").alias("cost"), F.count("*").alias("n")).join(members, ["section", "grp"])
    return whole.where("n = members").select("section", "grp", F.col("start").alias("slot"), "cost")


def assign_groups(costs: DataFrame, groups: DataFrame) -> DataFrame:
    """(section, pin, slot): a least-cost assignment of whole groups, as in `group_costs`; pins without a group aren't placed."""
    best = assign(group_costs(costs, groups).withColumnRenamed("grp", "pin")).select("section", F.col("pin").alias("grp"), F.col("slot").alias("start"))
    pins = costs.select("section", "pin").distinct().join(groups, "pin")
    return pins.join(best, ["section", "grp"]).select("section", "pin", (F.col("start") + F.col("place")).alias("slot"))


def mirror_costs(costs: DataFrame, mirrors: DataFrame, opposite: DataFrame) -> DataFrame:
    """(section, pin, mirror, pair, slot, other, cost): what a pin and its mirror cost on opposite slots.

    mirrors (pin, mirror); opposite (slot, other) holds both directions, and the opposites of one section's slots lie in
    one other section. Both slots are one `pair`, named by the smaller one, and both sections one by the smaller one, so
    that pins of either side compete for the same pairs.
    """
    own = costs.join(mirrors, "pin").join(opposite, "slot")
    far = costs.select(F.col("section").alias("far"), F.col("pin").alias("mirror"), F.col("slot").alias("other"), F.col("cost").alias("more"))
    both = own.join(far, ["mirror", "other"])
    return both.select(F.least("section", "far").alias("section"), "pin", "mirror", F.least("slot", "other").alias("pair"), "slot", "other", (F.col("cost") + F.col("more")).alias("cost"))


def assign_mirrored(costs: DataFrame, mirrors: DataFrame, opposite: DataFrame) -> DataFrame:
    """(pin, slot): mirrored pins first, at the least summed cost on opposite slots, then the others on what is left."""
    priced = mirror_costs(costs, mirrors, opposite)
    best = assign(priced.select("section", "pin", F.col("pair").alias("slot"), "cost")).select("pin", F.col("slot").alias("pair"))
    placed = best.join(priced, ["pin", "pair"]).select(F.explode(F.array(F.struct("pin", "slot"), F.struct(F.col("mirror").alias("pin"), F.col("other").alias("slot")))).alias("p"))
    placed = cut_lineage(placed.select("p.pin", "p.slot"))
    rest = costs.join(placed.select("pin"), "pin", "left_anti").join(placed.select("slot"), "slot", "left_anti")
    return placed.unionByName(assign(rest.select("section", "pin", "slot", "cost")).select("pin", "slot"))


def pack_sequence_pairs(blocks: DataFrame) -> DataFrame:
    """blocks (pair, block, first, second, w, h) -> (pair, block, x, y): a sequence pair's packing.

    first and second are the block's places in the two sequences. A block is left of another if it is before it in
    both, and below it if it is behind it in the first only; places are longest paths.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, s = pdf["first"].to_numpy(), pdf["second"].to_numpy()
        x, y = np.zeros(len(pdf)), np.zeros(len(pdf))
        for i in np.argsort(f, kind="stable"):
            left = (f < f[i]) & (s < s[i])
            x[i] = (x[left] + pdf.w.to_numpy()[left]).max(initial=0)
        for i in np.argsort(-f, kind="stable"):
            below = (f > f[i]) & (s < s[i])
            y[i] = (y[below] + pdf.h.to_numpy()[below]).max(initial=0)
        return pd.DataFrame({"pair": pdf.pair, "block": pdf.block, "x": x, "y": y})

    return blocks.groupBy("pair").applyInPandas(run, "pair long, block long, x double, y double")


#: annealing runs that are stepped together
TOGETHER = 2048


def _boxes(f: np.ndarray, s: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Areas of the packings of sequence pairs; f, s, w, h have a row for each run and a column for each block."""
    x, y = np.zeros(f.shape), np.zeros(f.shape)
    run, order = np.arange(len(f)), np.argsort(f, axis=1)
    for k in range(f.shape[1]):
        i = order[:, k]
        left = (f < k) & (s < s[run, i][:, None])
        x[run, i] = np.where(left, x + w, 0).max(1)
    for k in range(f.shape[1] - 1, -1, -1):
        i = order[:, k]
        below = (f > k) & (s < s[run, i][:, None])
        y[run, i] = np.where(below, y + h, 0).max(1)
    return (x + w).max(1) * (y + h).max(1)


def _anneal(draws: list[np.random.Generator], w: np.ndarray, h: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least areas of runs of n blocks each and the places that gave them; a run's draws are its own."""
    n = w.shape[1]
    f, s = (np.array([r.permutation(n) for r in draws]).reshape(-1, n) for _ in "fs")
    cost = _boxes(f, s, w, h)
    best, best_f, best_s, heat = cost.copy(), f.copy(), s.copy(), cost / 4 + 1e-9
    u = np.array([r.random((steps, 5)) for r in draws]) if n > 1 else np.zeros((len(draws), 0, 5))
    for k in range(u.shape[1]):
        i = (u[:, k, 0] * n).astype(int)
        j = (i + 1 + (u[:, k, 1] * (n - 1)).astype(int)) % n
        g, t = f.copy(), s.copy()
        for places, moved in ((g, np.flatnonzero(u[:, k, 2] < 0.7)), (t, np.flatnonzero(u[:, k, 3] < 0.5))):
            a, b = i[moved], j[moved]
            places[moved, a], places[moved, b] = places[moved, b], places[moved, a]
        new = _boxes(g, t, w, h)
        taken = u[:, k, 4] < np.exp(np.minimum((cost - new) / heat, 0))
        f[taken], s[taken], cost[taken] = g[taken], t[taken], new[taken]
        less = taken & (new < best)
        best[less], best_f[less], best_s[less] = new[less], g[less], t[less]
        heat *= 0.985
    return best, best_f, best_s


def anneal_packings(blocks: DataFrame, seeds: int = 16, steps: int = 300, tasks: int = 256) -> DataFrame:
    """blocks (grp, block, w, h) -> (grp, seed, area, firsts, seconds): for each group the smallest box of independent
    annealing runs; firsts and seconds are the places of its blocks, by id, in the two sequences.

    A group is few blocks. Each group and seed is a run of its own; a run swaps two blocks in one or both sequences. The
    runs are dealt to `tasks` tasks, as their rows are few but their work isn't; a task steps the runs of equally many
    blocks together. What a run draws depends on its group and seed alone.
    """
    listed = blocks.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("block", "w", "h"))).alias("b"))
    runs = listed.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).repartition(tasks, "grp", "seed")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf.b.map(len)
            for n in sorted(set(size)):
                alike = pdf[size == n]
                for at in range(0, len(alike), TOGETHER):
                    own = alike.iloc[at : at + TOGETHER]
                    draws = [np.random.default_rng([int(seed), int(grp) & 0xFFFFFFFF]) for grp, seed in zip(own.grp, own.seed, strict=True)]
                    w, h = (np.array([[k[c] for k in b] for b in own.b], float) for c in "wh")
                    area, f, s = _anneal(draws, w, h, steps)
                    yield pd.DataFrame({"grp": own.grp.to_numpy(), "seed": own.seed.to_numpy(), "area": area, "firsts": list(f), "seconds": list(s)})

    done = runs.mapInPandas(run, "grp long, seed long, area double, firsts array<long>, seconds array<long>")
    return done.groupBy("grp").agg(F.min(F.struct("area", "seed", "firsts", "seconds")).alias("m")).select("grp", "m.seed", "m.area", "m.firsts", "m.seconds")


def timing_model(arcs: DataFrame, port_in: Column, port_out: Column, hops: int) -> DataFrame:
    """arcs (src, dst, delay) -> (port_in, port_out, delay): the largest delay over paths of `hops` arcs between ports.

    Paths are folded to (start port, node) after each arc, so their number doesn't grow with the length; the last arcs are folded to
    (node, end port) before, so that their join goes straight to the pairs of ports.
    """
    at = arcs.groupBy(port_in.alias("port_in"), F.col("dst").alias("node")).agg(F.max("delay").alias("delay"))
    for _ in range(hops - 2):
        step = arcs.select(F.col("src").alias("node"), "dst", F.col("delay").alias("more"))
        at = at.join(step, "node").groupBy("port_in", F.col("dst").alias("node")).agg(F.max(F.col("delay") + F.col("more")).alias("delay"))
    if hops < 2:
        return at.withColumnRenamed("node", "dst").groupBy("port_in", port_out.alias("port_out")).agg(F.max("delay").alias("delay"))
    last = arcs.groupBy(F.col("src").alias("node"), port_out.alias("port_out")).agg(F.max("delay").alias("more"))
    return at.join(last, "node").groupBy("port_in", "port_out").agg(F.max(F.col("delay") + F.col("more")).alias("delay"))


def kmeans(points: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """points (id, x array) -> (id, cluster): Lloyd's rounds from the k points of the least hashed ids.

    A round is one pass over the points, which are assigned and summed up in place, in one job: a task gives its sums only, a row
    for each centre, and the centres, which must be few, are kept by the driver.
    """
    from netloom.operators.graph import kmeans_assign

    points = cut_lineage(points.select("id", "x"))
    spark = points.sparkSession
    centres = [r.x for r in points.orderBy(F.xxhash64("id"), "id").limit(k).orderBy("id").collect()]  # k rows
    for _ in range(rounds if centres else 0):
        sums = points.select("x").mapInArrow(_sums_by_centre(centres), "c int, rows long, n array<long>, s array<double>").collect()
        moved, gaps = list(centres), []
        for c, old in enumerate(centres):
            own = [r for r in sums if r.c == c]
            if sum(r.rows for r in own):  # a centre without points stays
                n, s = (np.sum([r[f] for r in own], axis=0) for f in ("n", "s"))
                moved[c] = [float(y) / int(m) if m else None for y, m in zip(s, n, strict=True)]
            if old is not None and len(old) == len(moved[c]) and None not in (*old, *moved[c]):
                gaps.append(sum(abs(x - y) for x, y in zip(moved[c], old, strict=True)))
        centres = moved
        if not gaps or max(gaps) < 1e-9:
            break
    table = spark.createDataFrame(list(enumerate(centres)), "c long, x array<double>")
    return kmeans_assign(points, table)


def _sums_by_centre(centres: list):
    """A task of a round: for each centre the points next to it, as `kmeans_assign` finds it, and each coordinate's values that aren't null
    and their sum."""
    dims = max((len(x) for x in centres if x is not None), default=0)
    whole = [x is not None and len(x) == dims and None not in x for x in centres]
    m = np.array([x if w else [0.0] * dims for x, w in zip(centres, whole, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, s = np.zeros(len(m), np.int64), np.zeros((len(m), dims), np.int64), np.zeros((len(m), dims))
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            keep = at[1] < dims
            at = at[0][keep], at[1][keep]
            flat = lists.flatten()
            x, known = np.zeros((len(size), dims)), np.zeros((len(size), dims), bool)
            x[at] = flat.fill_null(0).to_numpy(zero_copy_only=False)[keep]
            known[at] = flat.is_valid().to_numpy(zero_copy_only=False)[keep]
            gap = np.zeros((len(size), len(m)))
            for j in range(dims):  # summed in the order of the coordinates
                gap += (x[:, j, None] - m[None, :, j]) ** 2
            gap[np.isnan(gap)] = np.inf
            gap[~(known.all(1) & (size == dims)), :] = -np.inf  # null comes before any distance
            gap[:, ~np.array(whole)] = -np.inf
            to = gap.argmin(1)
            rows += np.bincount(to, minlength=len(m))
            for c in range(len(m)):
                n[c] += known[to == c].sum(0)
                s[c] += x[to == c].sum(0)
        yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(m)), pa.int32()), "rows": rows, "n": pa.array(n.tolist(), pa.list_(pa.int64())), "s": pa.array(s.tolist(), pa.list_(pa.float64()))})

    return run


#: wires of a net that `wire_islands` takes as one row
NET_WIRES = 1 << 16


def wire_islands(shapes: DataFrame, most: int = NET_WIRES) -> DataFrame:
    """shapes (net, a, b), wires between two points -> (net, islands): 1 says that a net is connected.

    Nets of at most `most` wires are a row each and are solved many at a time, after one shuffle; larger ones by rounds over tables.
    """
    from netloom.operators.graph import connected_components

    shapes = cut_lineage(shapes.select("net", "a", "b").distinct())
    large = cut_lineage(shapes.groupBy("net").count().where(F.col("count") > most).select("net"))
    rows = shapes.join(large, "net", "left_anti").groupBy("net").agg(F.collect_list(F.struct("a", "b")).alias("s")).select("net", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    small = rows.mapInPandas(_islands, f"net {shapes.schema['net'].dataType.simpleString()}, islands long")
    if large.isEmpty():
        return small
    wide = shapes.join(large, "net", "left_semi")
    ends = wide.select("net", F.explode(F.array("a", "b")).alias("p")).distinct().select(F.struct("net", "p").alias("v"))
    pins = wide.select(F.struct("net", "a", "b").alias("e"), "net", F.explode(F.array("a", "b")).alias("p")).select("e", F.struct("net", "p").alias("v"))
    comp = connected_components(ends, pins)
    return small.unionByName(comp.groupBy("v.net").agg(F.count_distinct("component").alias("islands")))


def _islands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (net, a, b), arrays of its wires' ends: the components of all nets of a batch at once, by least labels and jumps."""
    for pdf in frames:
        own = np.repeat(np.arange(len(pdf)), pdf.a.str.len().astype("int64"))
        points = pd.factorize(np.concatenate([*pdf.a, *pdf.b]))[0] if len(pdf) else np.empty(0, "int64")
        wide = int(points.max(initial=0)) + 1
        keys, place = np.unique(np.concatenate([own, own]) * wide + points, return_inverse=True)
        a, b = place[: len(own)], place[len(own) :]
        label = np.arange(len(keys))
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            for end in (a, b):
                np.minimum.at(label, label[end], low)
            while (label != label[label]).any():
                label = label[label]
        roots = keys[label == np.arange(len(keys))] // wide
        yield pd.DataFrame({"net": pdf.net, "islands": np.bincount(roots, minlength=len(pdf))})


def wireload(fanout: Column, table: dict[int, float], slope: float) -> Column:
    """Wire length of a fan-out: the table's entry, past its end its last one plus slope a pin, before its start the first."""
    keys = sorted(table)
    out = F.lit(table[keys[-1]]) + slope * (fanout - keys[-1])
    for k in reversed(keys):
        out = F.when(fanout <= k, F.lit(table[k])).otherwise(out)
    return out


def latch_borrow(arrival: Column, opens: Column, closes: Column) -> tuple[Column, Column]:
    """(borrowed, given): time borrowed from the next stage, at most until the latch closes, and its adjusted start."""
    borrowed = F.greatest(F.least(arrival, closes) - opens, F.lit(0))
    return borrowed, opens + borrowed


def legal_orients(symmetry_x: Column, symmetry_y: Column) -> Column:
    """Orientations that a cell's symmetry allows without a quarter turn."""
    both = F.array(F.lit("R0"), F.lit("MX"), F.lit("MY"), F.lit("R180"))
    return F.when(symmetry_x & symmetry_y, both).when(symmetry_x, F.array(F.lit("R0"), F.lit("MX"))).when(symmetry_y, F.array(F.lit("R0"), F.lit("MY"))).otherwise(F.array(F.lit("R0")))
