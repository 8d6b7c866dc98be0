import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import netlist
from netloom.sources import sinks, text


def test_assignment_is_optimal(spark):
    r = random.Random(6)
    cost = {(s, p, q): float(r.randint(0, 30)) for s in range(4) for p in range(4) for q in range(5)}
    df = spark.createDataFrame([(*k, c) for k, c in cost.items()], "section long, pin long, slot long, cost double")
    out = netlist.assign(df).collect()
    for s in range(4):
        own = {x.pin: x.slot for x in out if x.section == s}
        best = min(sum(cost[s, p, q] for p, q in enumerate(o)) for o in itertools.permutations(range(5), 4))
        assert len(set(own.values())) == 4 and sum(cost[s, p, q] for p, q in own.items()) == best
    with pytest.raises(Exception, match="pins"):
        netlist.assign(spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 1.0)], df.schema)).collect()


def test_legal_rows_keep_order_without_overlap(spark):
    r = random.Random(1)
    cells = [(i // 20, i, float(r.randint(0, 40)), float(r.randint(1, 5))) for i in range(60)]
    out = {x.cell: x.x for x in netlist.shift_legalise(spark.createDataFrame(cells, "row long, cell long, x double, width double")).collect()}
    for row in range(3):
        own = sorted((c for c in cells if c[0] == row), key=lambda c: (c[2], c[1]))
        for a, b in zip(own, own[1:], strict=False):
            assert out[a[1]] + a[3] <= out[b[1]] + 1e-9
    alone = netlist.shift_legalise(spark.createDataFrame([(0, 1, 3.0, 2.0), (0, 2, 9.0, 2.0)], "row long, cell long, x double, width double"))
    assert sorted((x.cell, x.x) for x in alone.collect()) == [(1, 3.0), (2, 9.0)]


def test_packings_do_not_overlap(spark):
    r = random.Random(3)
    rows = []
    for pair in range(5):
        f, s = r.sample(range(7), 7), r.sample(range(7), 7)
        rows += [(pair, b, f[b], s[b], float(r.randint(1, 5)), float(r.randint(1, 5))) for b in range(7)]
    df = spark.createDataFrame(rows, "pair long, block long, first long, second long, w double, h double")
    size = {(x[0], x[1]): x[4:] for x in rows}
    out = netlist.pack_sequence_pairs(df).collect()
    for a, b in itertools.combinations(out, 2):
        if a.pair == b.pair:
            (aw, ah), (bw, bh) = size[a.pair, a.block], size[b.pair, b.block]
            assert a.x + aw <= b.x or b.x + bw <= a.x or a.y + ah <= b.y or b.y + bh <= a.y
    squares = spark.createDataFrame([(g, 4 * g + i, 2.0, 2.0 + g) for g in range(2) for i in range(4)], "grp long, block long, w double, h double")
    best = {r.grp: r for r in netlist.anneal_packings(squares, seeds=4).collect()}
    assert best[0].area == 16.0 and best[1].area == 24.0 and sorted(best[1].firsts) == [0, 1, 2, 3]


def test_moves_and_regions_with_ties(spark):
    """Against the plain definition: boxes of the other pins, with equal places and nets of one pin."""
    from netloom.operators import spatial

    r = random.Random(6)
    at = {v: (r.randint(0, 4), r.randint(0, 4)) for v in range(12)}
    nets = {e: r.sample(range(12), r.randint(1, 5)) for e in range(15)}
    pins = spark.createDataFrame([(e, v) for e, vs in nets.items() for v in vs], "e long, v long")
    coords = spark.createDataFrame([(v, *xy) for v, xy in at.items()], "v long, x long, y long")
    moves = spark.createDataFrame([(v, 4 - at[v][1], at[v][0]) for v in at], "v long, nx long, ny long")
    span = lambda ps: sum(max(p[i] for p in ps) - min(p[i] for p in ps) for i in (0, 1))
    new = {v: (4 - at[v][1], at[v][0]) for v in at}
    want = {v: sum(span([new[u] if u == v else at[u] for u in vs]) - span([at[u] for u in vs]) for vs in nets.values() if v in vs) for v in at if any(v in vs for vs in nets.values())}
    assert {x.v: x.delta for x in spatial.hpwl_move_delta(pins, coords, moves).collect()} == want
    for axis, i in (("x", 0), ("y", 1)):
        bounds = {v: sorted(b for vs in nets.values() if v in vs and len(vs) > 1 for b in (min(at[u][i] for u in vs if u != v), max(at[u][i] for u in vs if u != v))) for v in at}
        want = {v: (b[len(b) // 2 - 1], b[len(b) // 2]) for v, b in bounds.items() if b}
        assert {x.v: tuple(x)[1:] for x in spatial.optimal_region(pins, coords, axis).collect()} == want


def test_endpoints_corners_and_skews(spark):
    from netloom.operators import timing

    rows = [("g", "a", i, float(i), "p" if i < 3 else f"p{i}") for i in range(6)] + [("g", "b", 10 + i, float(i) + 0.5, f"q{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "grp string, endpoint string, path long, slack double, pins string")
    got = [(r.endpoint, r.path, r["rank"]) for r in timing.endpoint_paths(df, 3, 2).orderBy("rank").collect()]
    assert got == [("a", 0, 1), ("b", 10, 2), ("a", 1, 3)]
    assert {r.path for r in timing.endpoint_paths(df, 9, 2, unique_pins=True).collect()} == {0, 3, 10, 11}
    c = spark.createDataFrame([("fast", 1, 3), ("slow", 1, -1), ("fast", 2, 0), ("slow", 2, 0)], "corner string, node long, slack long")
    assert {tuple(r) for r in timing.worst_corner(c).collect()} == {(1, "slow", -1), (2, "fast", 0)}
    k = spark.createDataFrame([(1, 10, 4, 5), (2, 3, 3, 1), (3, 9, 1, 2)], "check_id long, clk_at long, ref_at long, most long")
    assert [tuple(r) for r in timing.max_skew_checks(k).orderBy("rank").collect()] == [(3, 8, -6, 1), (1, 6, -1, 2), (2, 0, 1, 3)]


def test_windows_reorder_to_wishes(spark):
    cells = spark.createDataFrame([(0, 1, 0, 1, 2), (0, 2, 1, 1, 1), (0, 3, 2, 1, 0), (0, 4, 3, 1, 3)], "row long, cell long, x long, width long, wish long")
    assert [(r.window, r.place, r.cell) for r in netlist.reorder_windows(cells).orderBy("window", "place").collect()] == [(0, 0, 3), (0, 1, 2), (0, 2, 1), (1, 0, 4)]


def test_kmeans_rounds_reach_a_fixed_point(spark):
    pts = [(i, [float(i % 3) * 10 + (i % 5) * 0.1, 0.0]) for i in range(60)]
    out = {r.id: r.cluster for r in netlist.kmeans(spark.createDataFrame(pts, "id long, x array<double>"), 3, 20).collect()}
    assert len(out) == 60
    mean = {c: sum(x[0] for i, x in pts if out[i] == c) / sum(v == c for v in out.values()) for c in set(out.values())}
    for i, x in pts:  # a fixed point: every point is in the cluster of the nearest mean
        assert abs(x[0] - mean[out[i]]) <= min(abs(x[0] - m) for m in mean.values()) + 1e-9


def test_islands_and_patterns(spark):
    w = spark.createDataFrame([("n", 1, 2), ("n", 2, 3), ("m", 1, 2), ("m", 5, 6)], "net string, a long, b long")
    assert {tuple(r) for r in netlist.wire_islands(w).collect()} == {("n", 1), ("m", 2)}
    g = spark.createDataFrame([("a", "u?_x*"), ("b", "100%")], "grp string, pattern string")
    i = spark.createDataFrame([("u1_x9",), ("u1ax9",), ("100%",), ("1000",)], "inst string")
    assert sorted(map(tuple, netlist.pattern_members(g, i).collect())) == [("a", "u1_x9"), ("b", "100%")]


def test_more_writers(spark, tmp_path):
    insts = spark.createDataFrame([("u1", "INV"), ("u2", "FILL")], "inst string, master string")
    pins = spark.createDataFrame([("u1", 1, "Y", "n2"), ("u1", 0, "A", "n1")], "inst string, pos int, term string, net string")
    assert [r.line for r in sinks.verilog_lines(insts, pins, ["FILL"]).collect()] == ["INV u1 (.A(n1), .Y(n2));"]
    assert sinks.cdl_lines(insts, pins).where("inst = 'u1'").first().line == "Xu1 n1 n2 INV"
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    gates = spark.createDataFrame([(1, "INV", ["A=a", "Y=y"])], "gate int, cell string, pins array<string>")
    body = "\n".join(r.line for r in sinks.blif_lines("m", names("a"), names("y"), gates).orderBy("kind", "id").collect())
    (tmp_path / "b.blif").write_text(body)
    assert [tuple(r) for r in text.read_blif(spark, str(tmp_path / "b.blif"))["gates"].collect()] == [("gate", "INV", ["A=a", "Y=y"])]
    caps = spark.createDataFrame([("n", 1.5, "n:1", None, 1.0), ("n", 1.5, "n:1", "m:1", 0.5)], "net string, total double, node string, other string, cap double")
    res = spark.createDataFrame([("n", "n:1", "n:2", 3.0)], "net string, a string, b string, res double")
    (tmp_path / "a.spef").write_text("\n".join(r.line for r in sinks.spef_lines(caps, res).collect()))
    back, r = text.read_spef(spark, str(tmp_path / "a.spef"))
    assert sorted(map(str, back.collect())) == sorted(map(str, caps.collect())) and r.collect() == res.collect()
    assert sinks.spice_lines(res.select("a", "b", "res"), spark.createDataFrame([("n:1", 1.1)], "node string, volt double")).count() == 2


def test_writers_of_placement(spark, tmp_path):
    x = spark.createDataFrame([(2, 0.5, 1.5), (1, 1.0, 2.0)], "v long, x double, y double")
    p = spark.createDataFrame([(1, 0), (2, 1)], "v long, part int")
    sinks.write_embedding_csv(x, p, str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["Eigen1,Eigen2,Partition", "1.0,2.0,0", "0.5,1.5,1"]
    sinks.write_clusters(p.withColumnRenamed("part", "cluster"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["1,0", "2,1"]
    sinks.write_partitioned(x, p, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where(F.col("part") == 1).count() == 1
    s = spark.createDataFrame([("p", 0, "a", 1, 2, 0.5, 0.1)], "path string, pos int, pin string, x int, y int, arrival double, slew double")
    assert sinks.path_json(s).first().json == '{"path":[{"pin":"a","x":1,"y":2,"arrival":0.5,"slew":0.1}]}'


def test_groups_and_mirrors_against_all_choices(spark):
    r = random.Random(8)
    cost = {(p, s): r.randint(0, 50) for p in (1, 2, 3, 4) for s in range(9)}
    costs = spark.createDataFrame([(0, p, s, float(c)) for (p, s), c in cost.items()], "section long, pin long, slot long, cost double").coalesce(2)
    groups = spark.createDataFrame([(1, 70, 1), (2, 70, 0), (3, 80, 0)], "pin long, grp long, place long")
    got = {x.pin: x.slot for x in netlist.assign_groups(costs, groups).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] + 1 and got[2] % 2 == 0 and got[3] % 2 == 0
    best = min(cost[2, a] + cost[1, a + 1] + cost[3, b] for a in (0, 2, 4, 6) for b in (0, 2, 4, 6, 8) if a != b)
    assert sum(cost[p, s] for p, s in got.items()) == best
    with pytest.raises(Exception, match="pairs given|slots"):
        netlist.assign_groups(costs.where("slot < 2"), groups).collect()

    # pins 1, 3, 5 on edge 0 (slots 0-3), 2, 4 on edge 1 (slots 10-13); 1 and 2 mirror, 4 mirrors 3 from the other side
    edge = {p: p % 2 ^ 1 for p in range(1, 6)}
    cost = {(p, s): r.randint(0, 50) for p in edge for s in (range(4) if edge[p] == 0 else range(10, 14))}
    costs = spark.createDataFrame([(edge[p], p, s, float(c)) for (p, s), c in cost.items()], "section long, pin long, slot long, cost double").coalesce(2)
    opposite = spark.createDataFrame([x for s in range(4) for x in ((s, s + 10), (s + 10, s))], "slot long, other long")
    mirrors = spark.createDataFrame([(1, 2), (4, 3)], "pin long, mirror long")
    got = {x.pin: x.slot for x in netlist.assign_mirrored(costs, mirrors, opposite).collect()}
    assert set(got) == set(edge) and len(set(got.values())) == 5 and got[2] == got[1] + 10 and got[4] == got[3] + 10
    best = min(cost[1, a] + cost[2, a + 10] + cost[3, b] + cost[4, b + 10] for a, b in itertools.permutations(range(4), 2))
    assert sum(cost[p, got[p]] for p in (1, 2, 3, 4)) == best
    assert cost[5, got[5]] == min(cost[5, s] for s in range(4) if s not in (got[1], got[3]))
    none = netlist.assign_mirrored(costs, mirrors.where("false"), opposite)  # without mirrors a plain assignment
    assert none.count() == 5


def test_skews_under_groups_and_latencies(spark):
    from netloom.operators import timing

    regs = spark.createDataFrame([(1, 10, 5), (2, 10, 8), (3, 20, 1), (4, 30, 2)], "reg long, clk long, at long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (4, 1), (9, 1)], "src long, dst long")
    late = spark.createDataFrame([(10, 4), (20, None)], "clk long, late long")
    groups = spark.createDataFrame([(10, 1), (20, 2)], "clk long, grp long")
    got = {tuple(r) for r in timing.constrained_skews(regs, pairs, late, groups).collect()}
    assert got == {(1, 2, 10, 10, -3), (3, 4, 20, 30, -1), (4, 1, 30, 10, -7)}  # 10 and 20 are apart, 30 is in no group
    assert timing.constrained_skews(regs, pairs, late, groups.where("false")).count() == 4


def test_annealing_runs_step_together_and_alone_alike(spark):
    rng = np.random.default_rng(3)
    w, h = rng.integers(1, 9, (2, 5, 6)).astype(float)
    draws = lambda which: [np.random.default_rng([i, 7]) for i in which]
    area, f, s = netlist._anneal(draws(range(5)), w, h, 80)
    for i in range(5):  # each run's draws are its own, and its area is that of the sequence pair it returns
        assert netlist._anneal(draws([i]), w[i : i + 1], h[i : i + 1], 80)[0][0] == area[i]
        x, y = np.zeros(6), np.zeros(6)
        for b in np.argsort(f[i]):
            x[b] = max([x[a] + w[i, a] for a in range(6) if f[i, a] < f[i, b] and s[i, a] < s[i, b]], default=0)
        for b in np.argsort(-f[i]):
            y[b] = max([y[a] + h[i, a] for a in range(6) if f[i, a] > f[i, b] and s[i, a] < s[i, b]], default=0)
        assert (x + w[i]).max() * (y + h[i]).max() == area[i]


def test_kmeans_of_no_points(spark):
    assert netlist.kmeans(spark.createDataFrame([], "id long, x array<double>"), 3, 2).count() == 0


def test_clock_nets_keep_bits_until_the_result(spark, monkeypatch):
    """300 clocks, so two rows a node; a loop, a clock of two sources, a shared node. Written tables hold far fewer rows than pairs."""
    rows = []
    real = netlist.cut_lineage

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(netlist, "cut_lineage", counted)
    sources = [(f"c{i}", i) for i in range(300)] + [("c7", 500), ("c8", 7)]
    pairs = [(i, 400) for i in range(0, 300, 2)] + [(400, 401), (401, 402), (402, 401), (500, 402), (299, 403)]
    out = netlist.clock_nets(spark.createDataFrame(sources, "clock string, node long"), spark.createDataFrame(pairs, "src long, dst long"))
    got = [(r.clock, r.node) for r in out.collect()]
    want = set(sources)
    while more := {(c, d) for c, n in want for s, d in pairs if s == n} - want:
        want |= more
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(rows) < 2 * len(want)  # before, pairs were written once as found and again in each round


def test_islands_of_small_nets_need_no_rounds(spark, monkeypatch):
    """Chains, loops, repeated wires and points that nets share; both ways give what a search does, small nets without rounds."""
    from netloom.operators import graph

    r = random.Random(3)
    wires = [(n, r.randint(0, n), r.randint(0, n)) for n in range(40) for _ in range(n // 2 + 1)] + [(50, i, i + 1) for i in range(30)] * 2 + [(51, 5, 5)]
    want = {}
    for net in {w[0] for w in wires}:
        own = [w for w in wires if w[0] == net]
        at = {p: p for _, a, b in own for p in (a, b)}
        for _ in at:
            for _, a, b in own:
                at[a] = at[b] = min(at[a], at[b])
        want[net] = len(set(at.values()))
    shapes = spark.createDataFrame(wires, "net long, a long, b long").coalesce(2)
    assert {x.net: x.islands for x in netlist.wire_islands(shapes, most=12).collect()} == want
    monkeypatch.setattr(graph, "connected_components", None)
    assert {x.net: x.islands for x in netlist.wire_islands(shapes).collect()} == want


def test_queries_of_one_place_are_looked_up_once(spark, monkeypatch):
    from netloom.operators import spatial

    made, real = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: made.append(real(df)) or made[-1])
    points = spark.createDataFrame([(i, i % 9 * 1.5, i // 9 * 2.0) for i in range(80)], "id long, x double, y double")
    queries = spark.createDataFrame([(i, 3.0 + 20 * (i % 2), 1.0) for i in range(60)], "q long, x double, y double")
    got = {(r.q, r["rank"], r.id, r.d2) for r in spatial.k_nearest(queries, points, 3).collect()}
    far = lambda q: sorted(((i % 9 * 1.5 - 3.0 - 20 * (q % 2)) ** 2 + (i // 9 * 2.0 - 1.0) ** 2, i) for i in range(80))[:3]
    assert got == {(q, n + 1, i, d2) for q in range(60) for n, (d2, i) in enumerate(far(q))}
    assert max(t.count() for t in made if "rank" in t.columns) <= 2 * 3


def test_last_hop_goes_to_pairs_of_ports(spark):
    arcs = [(a, b, (a * 7 + b * 3) % 10 + 1) for a in range(12) for b in range(12) if (a + 2 * b) % 5 == 1]
    df = spark.createDataFrame(arcs, "src long, dst long, delay long")
    for hops in (1, 2, 3):
        paths = [[a] for a in arcs]
        for _ in range(hops - 1):
            paths = [[*p, a] for p in paths for a in arcs if a[0] == p[-1][1]]
        want = {}
        for p in paths:
            key = (p[0][0] % 4, p[-1][1] % 3)
            want[key] = max(want.get(key, 0), sum(a[2] for a in p))
        out = netlist.timing_model(df, F.col("src") % 4, F.col("dst") % 3, hops)
        assert {(r.port_in, r.port_out): r.delay for r in out.collect()} == want
    # paths aren't dealt by (start port, node) once more before they are folded to pairs
    plan = netlist.timing_model(df, F.col("src") % 4, F.col("dst") % 3, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [port_in") <= 1 and plan.count("port_out") > 0



def test_optimal_regions_of_both_axes(spark):
    from netloom.operators import spatial

    pins = spark.createDataFrame([(e, (e * 5 + j * j) % 23) for e in range(30) for j in range(e % 5 + 1)], "e long, v long").distinct()
    coords = spark.createDataFrame([(v, v * 7 % 10, v * 3 % 11) for v in range(23)], "v long, x long, y long")
    both = spatial.optimal_region(pins, coords).join(spatial.optimal_region(pins, coords, "y"), "v")
    assert {tuple(r) for r in spatial.optimal_regions(pins, coords).collect()} == {tuple(r) for r in both.collect()}


def test_a_round_of_kmeans_is_one_job(spark, monkeypatch):
    r = random.Random(3)
    pts = [(i, [r.random() * 9, r.random() * 9]) for i in range(90)]
    df = spark.createDataFrame(pts, "id long, x array<double>")
    made = []
    monkeypatch.setattr(netlist, "cut_lineage", lambda d: made.append(1) or d.localCheckpoint())
    out = {x.id: x.cluster for x in netlist.kmeans(df, 4, 3).collect()}
    assert len(made) == 1  # the points; rounds write nothing
    centres = [dict(pts)[x.id] for x in df.orderBy(F.xxhash64("id"), "id").limit(4).orderBy("id").collect()]
    near = lambda x: min(range(4), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, centres[c])), c))
    for _ in range(3):
        own = [[x for _, x in pts if near(x) == c] for c in range(4)]
        centres = [[sum(y) / len(g) for y in zip(*g)] if g else centres[c] for c, g in enumerate(own)]
    assert out == {i: near(x) for i, x in pts}


def test_kmeans_of_points_with_nulls(spark):
    pts = [(0, [0.0, 0.0]), (1, [1.0, None]), (2, None), (3, [9.0, 9.0]), (4, [8.0, 9.0]), (5, [0.0, 1.0])]
    out = netlist.kmeans(spark.createDataFrame(pts, "id long, x array<double>"), 6, 3).collect()
    assert sorted(x.id for x in out) == list(range(6)) and all(x.cluster is not None for x in out)
