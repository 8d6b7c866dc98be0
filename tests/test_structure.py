"""Incremental timing, modularity, balanced clusters and trees against brute force on small inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import balanced, graph, incremental, modularity, partition, trees
from netloom.operators.hypergraph import Hypergraph
from netloom.operators.ordered import row_numbers


def test_update_equals_full_propagation_and_visits_little(spark):
    r = random.Random(4)
    arcs = {(a, b): r.randint(1, 9) for a in range(60) for b in r.sample(range(a + 1, min(a + 9, 61)), min(2, 60 - a))}
    removed = r.sample(sorted(arcs), 3)
    added = [(3, 50, 40), (58, 60, 7), (removed[0][0], removed[0][1], 90)]
    df = spark.createDataFrame([(a, b, d) for (a, b), d in arcs.items()], "src long, dst long, delay long")
    nodes = spark.range(61).withColumnRenamed("id", "node")
    gone, new = spark.createDataFrame(removed, "src long, dst long"), spark.createDataFrame(added, "src long, dst long, delay long")
    after = incremental.apply_changes(df, gone, new)
    heads = gone.select(F.col("dst").alias("node")).union(new.select("dst"))
    for late in (True, False):
        state = incremental.full_state(nodes, df, late)
        got = incremental.update(state, after, heads, late)
        assert {tuple(x) for x in got.state.collect()} == {tuple(x) for x in incremental.full_state(nodes, after, late).collect()}
    one = incremental.update(state, df, nodes.where("node = 59"), False)  # nothing changed: the head alone is looked at
    assert (one.visited, one.rounds, one.changed.count()) == (1, 1, 0)
    last = spark.createDataFrame([(58, 60, 100)], "src long, dst long, delay long")
    late = incremental.full_state(nodes, df)
    end = incremental.update(late, df.unionByName(last), last.select(F.col("dst").alias("node")))
    assert end.visited == 1 and end.changed.count() == 1
    loop = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src long, dst long, delay long")
    small = incremental.full_state(spark.range(1, 4).withColumnRenamed("id", "node"), loop)
    back = loop.unionByName(spark.createDataFrame([(3, 1, 1)], "src long, dst long, delay long"))
    with pytest.raises(ValueError, match="cycle"):
        incremental.update(small, back, spark.range(1, 2).withColumnRenamed("id", "node"))


def brute_q(arcs, label, g):
    m2 = sum(arcs.values())
    tot, inside = {}, {}
    for (a, b), w in arcs.items():
        tot[label[a]] = tot.get(label[a], 0) + w
        inside[label[a]] = inside.get(label[a], 0) + (w if label[a] == label[b] else 0)
    return sum(inside[c] / m2 - g * (tot[c] / m2) ** 2 for c in tot)


def both_ways(pairs):
    out = {}
    for a, b, w in pairs:
        out[a, b] = out[b, a] = w
    return out


@pytest.mark.parametrize("resolution", [0.6, 1.0])
def test_communities_reach_the_best_modularity(spark, resolution):
    """Three rings of cliques: the best of all partitions, by enumeration, is found, and Q never falls."""
    cliques = [(0, 1, 2), (3, 4, 5), (6, 7)]
    arcs = both_ways([(a, b, 5) for c in cliques for a, b in itertools.combinations(c, 2)] + [(2, 3, 1), (5, 6, 2), (7, 0, 1)])
    best = max(brute_q(arcs, dict(enumerate(x)), resolution) for x in itertools.product(range(4), repeat=8))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src long, dst long, w long")
    label, found = modularity.communities(df, resolution)
    own = {r.v: r.label for r in label.collect()}
    assert abs(brute_q(arcs, own, resolution) - best) < 1e-9 and abs(found[-1] - best) < 1e-9
    assert found == sorted(found) and all(own[v] == min(u for u in own if own[u] == own[v]) for v in own)
    gains = modularity.move_gains(df, label, resolution).collect()
    for r in gains:
        assert abs(brute_q(arcs, {**own, r.v: r.target}, resolution) - best - r.gain) < 1e-9


def test_components_in_tasks_and_by_rounds_have_the_whole_q(spark, monkeypatch):
    cliques = [range(10 * i, 10 * i + 4) for i in range(5)]
    arcs = both_ways([(a, b, 3) for c in cliques for a, b in itertools.combinations(c, 2)] + [(10 * i + 3, 10 * i + 10, 1) for i in (0, 2)] + [(40 + a, 50 + b, 2) for a in range(4) for b in range(4)])
    df = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src long, dst long, w long")
    one, q = modularity.communities(df, 1.0, task_arcs=40)  # the last component has more arcs and goes by rounds
    own = {r.v: r.label for r in one.collect()}
    assert abs(brute_q(arcs, own, 1.0) - q[-1]) < 1e-9 and all(own[10 * i + j] == 10 * i for i in range(4) for j in range(4))
    monkeypatch.setattr(modularity, "local_moves", None)  # rounds over tables
    every, q = modularity.communities(df, 1.0)
    own = {r.v: r.label for r in every.collect()}
    assert abs(brute_q(arcs, own, 1.0) - q[-1]) < 1e-9 and all(own[10 * i + j] == 10 * i for i in range(4) for j in range(4))


def test_moves_that_share_no_community_add_up(spark):
    r = random.Random(9)
    arcs = both_ways([(a, b, r.randint(1, 5)) for a, b in itertools.combinations(range(14), 2) if r.random() < 0.3])
    df = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src long, dst long, w long")
    own = {v: v % 7 for v in {a for a, _ in arcs}}
    label = spark.createDataFrame(list(own.items()), "v long, label long")
    best = modularity.move_gains(df, label).groupBy("v", "label").agg(F.max_by("target", "gain").alias("target"), F.max("gain").alias("gain"))
    moves = modularity._independent(best).collect()
    ends = [c for m in moves for c in (m.label, m.target)]
    assert moves and len(set(ends)) == len(ends)
    new = own | {m.v: m.target for m in moves}
    assert abs(brute_q(arcs, new, 1.0) - brute_q(arcs, own, 1.0) - sum(m.gain for m in moves)) < 1e-9


@pytest.mark.parametrize("listed", [1, 256])
def test_balanced_assignment_costs_least(spark, listed):
    r = random.Random(5)
    for n, k, most in ((7, 3, 3), (6, 2, 3), (8, 3, 3)):
        points = [(i, [float(r.randint(0, 6)), float(r.randint(0, 3))]) for i in range(n)]
        centres = [(10 + c, [float(c), 0.0]) for c in range(k)]
        cost = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
        best = min(sum(cost(p[1], centres[c][1]) for p, c in zip(points, x, strict=True)) for x in itertools.product(range(k), repeat=n) if max(map(x.count, range(k))) <= most)
        out = balanced.assign(spark.createDataFrame(points, "id long, x array<double>"), spark.createDataFrame(centres, "c long, x array<double>"), most, listed).collect()
        assert abs(sum(x.cost for x in out) - best) < 1e-9 and len(out) == n
        assert all(sum(x.cluster == c for x in out) <= most for c, _ in centres)
        assert all(x.cost == cost(points[x.id][1], dict(centres)[x.cluster]) for x in out)
    with pytest.raises(ValueError, match="exceed"):
        balanced.assign(spark.createDataFrame(points, "id long, x array<double>"), spark.createDataFrame(centres, "c long, x array<double>"), 2)


def test_balanced_kmeans_converges(spark):
    points = spark.createDataFrame([(i, [float(i % 10 + 20 * (i // 30))]) for i in range(60)], "id long, x array<double>")
    label, centres = balanced.kmeans(points, spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [2.0])], "c long, x array<double>"), 20)
    assert sorted(r["count"] for r in label.groupBy("cluster").count().collect()) == [20, 20, 20]
    assert label.agg(F.sum("cost")).first()[0] < 1500 and centres.count() == 3


def random_tree(r, n):
    return [(r.randrange(i), i) for i in range(1, n)]


def below(edges, n, top, root=0):
    near = {v: [] for v in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    up, order = {root: None}, [root]
    for v in order:
        for u in near[v]:
            if u not in up:
                up[u] = v
                order.append(u)
    inside = set()
    for v in order:
        if v == top or up[v] in inside:
            inside.add(v)
    return inside, up


def test_tree_cuts_against_counting(spark):
    r = random.Random(8)
    n = 40
    edges = [tuple(r.sample(e, 2)) for e in random_tree(r, n)]
    hyper = {e: (r.sample(range(n), r.choice([1, 2, 3, 8])), r.randint(1, 5)) for e in range(30)}
    weight = [r.randint(1, 4) for _ in range(n)]
    h = Hypergraph(
        spark.createDataFrame([(v, w, None) for v, w in enumerate(weight)], "v long, vwt long, fixed int"), spark.createDataFrame([(e, w) for e, (_, w) in hyper.items()], "e long, hwt long"),
        spark.createDataFrame([(e, v) for e, (vs, _) in hyper.items() for v in vs], "e long, v long"),
    )
    df = spark.createDataFrame(edges, "src long, dst long")
    order = trees.preorder(h.vertices, df)
    for x in order.collect():
        inside, up = below(edges, n, x.node)
        assert (x.parent, x.root, x["size"]) == (up[x.node], 0, len(inside))
    pos = {x.node: x.pos for x in order.collect()}
    assert sorted(pos.values()) == list(range(1, n + 1)) and all(sorted(pos[u] for u in below(edges, n, v)[0])[0] == pos[v] for v in range(n))
    want = {}
    for v in range(1, n):
        inside, _ = below(edges, n, v)
        want[v] = (sum(w for vs, w in hyper.values() if 0 < len(inside & set(vs)) < len(vs)), sum(weight[u] for u in inside))
    assert {x.node: (x.cut, x.below) for x in trees.edge_cuts(h, order).collect()} == want
    most = 0.8 * sum(weight)
    fair = {v: c for v, (c, b) in want.items() if b <= most and sum(weight) - b <= most}
    best, parts = trees.best_tree_cuts(h, [df], balance=30, keep=2)
    assert sorted(x.cut for x in best.collect()) == sorted(fair.values())[:2]
    one = {x.v: x.part for x in parts[0].collect()}
    assert sum(w for vs, w in hyper.values() if len({one[v] for v in vs}) > 1) == min(fair.values())
    with pytest.raises(ValueError, match="cycle"):
        trees.preorder(h.vertices, df.union(spark.createDataFrame([(edges[0][0], edges[5][1])], "src long, dst long")).union(df.limit(1)))


def test_walked_trees_equal_ranked_ones(spark, monkeypatch):
    """Several trees of random shape, an isolated vertex: the same preorder by tasks of whole trees as by jumps."""
    r = random.Random(8)
    names = r.sample(range(1000), 80)
    edges = [(names[i], names[r.randrange(i - i % 25, i)]) if r.random() < 0.5 else (names[r.randrange(i - i % 25, i)], names[i]) for i in range(75) if i % 25]
    v, df = spark.createDataFrame([(x,) for x in names], "v long"), spark.createDataFrame(edges, "src long, dst long")
    ranked, used = trees._ranked, []
    monkeypatch.setattr(trees, "_ranked", lambda *a: used.append(1) or ranked(*a))
    rows = lambda: {tuple(x) for x in trees.preorder(v, df).collect()}
    walked = rows()
    assert len(walked) == 80 and not used
    monkeypatch.setattr(trees, "BATCH_NODES", 10)
    assert rows() == walked and not used
    monkeypatch.setattr(trees, "TREE_NODES", 10)
    assert rows() == walked and used


def test_low_stretch_forest(spark):
    """A spanning tree of a grid of unit arcs with some long ones: its mean stretch stays far below that of a path."""
    k = 12
    arcs = [(i * k + j, i * k + j + 1, 1) for i in range(k) for j in range(k - 1)] + [(i * k + j, i * k + j + k, 1) for i in range(k - 1) for j in range(k)]
    arcs += [(a, (a * 37) % (k * k), 40) for a in range(0, k * k, 7) if a != (a * 37) % (k * k)]
    df = spark.createDataFrame(arcs, "src long, dst long, w long")
    v = spark.range(k * k + 1).withColumnRenamed("id", "v")
    edges = trees.low_stretch_forest(v, df)
    assert edges.count() == k * k - 1
    order = trees.preorder(v, edges)
    out = trees.stretch(order, trees.parent_lengths(order, edges), df).collect()
    assert len(out) == len(arcs) and all(x.distance >= 1 for x in out)
    mean = sum(x.stretch for x in out) / len(out)
    assert mean < 8  # a path through all rows has about k on average for the arcs between rows
    near = {}
    for a, b, w in [tuple(e) for e in edges.collect()]:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    far, todo = {0: 0}, [0]
    for x in todo:
        for y, w in near[x]:
            if y not in far:
                far[y] = far[x] + w
                todo.append(y)
    assert all(x.distance == far[x.dst] for x in out if x.src == 0)


def test_sweep_touches_only_what_it_reaches(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1) for i in range(6)] + [(0, 4, 9), (9, 9, 1)], "src long, dst long, delay long")
    nodes = spark.range(10).withColumnRenamed("id", "node")
    got = {x.node: (x.arrival, x.level) for x in graph.sweep(nodes, arcs).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (9, 4), 5: (10, 5), 6: (11, 6), 7: (0, 0), 8: (0, 0)}
    assert {x.node: x.level for x in graph.levelize(nodes, arcs).collect()}[9] is None


def test_boolean_keys_against_truth_tables(spark):
    from netloom.functions import boolean

    r = random.Random(3)

    def expr(depth):
        if not depth or r.random() < 0.2:
            return r.choice(["A", "B", "C", "D", "0", "1"]) + r.choice(["", "", "'"])
        op = r.choice("&*|+^!(")
        return f"!{expr(0)}" if op == "!" else f"({expr(depth - 1)}){r.choice(['', chr(39)])}" if op == "(" else f"{expr(depth - 1)} {op} {expr(depth - 1)}"

    def truth(d, f):
        out = []
        for x in itertools.product((0, 1), repeat=4):
            value, at = dict(zip("ABCD", x, strict=True)), f
            while at > 1:
                port, low, high = d.nodes[at]
                at = high if value[d.ports[port]] else low
            out.append(at)
        return tuple(out)

    def direct(text):
        word = text.replace("*", "&").replace("+", "|")
        out = []
        for x in itertools.product((0, 1), repeat=4):
            cols = {n: F.lit(bool(v)) for n, v in zip("ABCD", x, strict=True)}
            from netloom.functions.scalar import boolean_function

            out.append(boolean_function(word, cols))
        return out

    exprs = [expr(3) for _ in range(60)]
    tables = {e: truth(*boolean.build(e)) for e in exprs}
    asked = spark.range(1).select(*[F.array(*direct(e)).alias(f"e{i}") for i, e in enumerate(exprs[:15])]).first()
    assert all(tuple(map(int, asked[i])) == tables[e] for i, e in enumerate(exprs[:15]))
    keys = {x.id: x for x in boolean.function_keys(spark.createDataFrame([*enumerate(exprs), (100, "A &"), (101, None)], "id long, expr string"), "A").collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate(exprs), 2):
        assert (keys[i].key == keys[j].key) == (tables[a] == tables[b])
    for i, e in enumerate(exprs):
        used = [n for k, n in enumerate("ABCD") if any(tables[e][x] != tables[e][x ^ (8 >> k)] for x in range(16))]
        assert keys[i].ports == used
        low, high = tables[e][:8], tables[e][8:]
        want = None if low == high else "buffer" if (set(low), set(high)) == ({0}, {1}) else "inverter" if (set(low), set(high)) == ({1}, {0}) else "and" if set(low) == {0} else "or" if set(high) == {1} else None
        assert keys[i].gate == want
    assert keys[100].key is None and keys[101].key is None


@pytest.mark.parametrize("most", [4, 9])
def test_chains_of_bits_against_filling(spark, most):
    from netloom.operators import sequence

    r = random.Random(most)
    cells = [(d, r.random() < 0.4, 1000 * d + i, r.randint(1, 4)) for d in range(4) for i in range([1, 60, 7, 25][d])]
    want, chain, bits, last = {}, 0, 0, None
    for d, _, cell, n in sorted(cells, key=lambda c: (c[0], not c[1], c[2])):
        if d != last:
            chain, bits, last = 0, 0, d
        elif bits + n > most:
            chain, bits = chain + 1, 0
        want[cell] = (d, chain, bits)
        bits += n
    out = sequence.scan_chains_of_bits(spark.createDataFrame(cells, "domain long, falling boolean, cell long, bits int"), most).collect()
    assert {x.cell: (x.domain, x.chain, x.first_bit) for x in out} == want
    with pytest.raises(ValueError, match="bits"):
        sequence.scan_chains_of_bits(spark.createDataFrame([(1, True, 1, most + 1)], "domain long, falling boolean, cell long, bits int"), most)


def test_chains_of_bits_take_two_passes_over_blocks(spark, monkeypatch):
    """Many blocks of one domain and of a null one equal plain filling, with a fixed number of tables."""
    from netloom.operators import sequence

    r, written = random.Random(2), []
    cells = [(d, False, 1000 * (d or 0) + i, r.randint(1, 4)) for d, n in ((None, 90), (2, 400)) for i in range(n)]
    want, chain, bits, last = {}, 0, 0, 0
    for d, _, cell, n in cells:
        if d != last:
            chain, bits, last = 0, 0, d
        elif bits + n > 10:
            chain, bits = chain + 1, 0
        want[cell] = (d, chain, bits)
        bits += n
    plain = sequence.cut_lineage
    monkeypatch.setattr(sequence, "SPAN", 16, raising=False)
    monkeypatch.setattr(sequence, "cut_lineage", lambda df: written.append(1) or plain(df))
    out = sequence.scan_chains_of_bits(spark.createDataFrame(cells, "domain long, falling boolean, cell long, bits int"), 10).collect()
    assert {x.cell: (x.domain, x.chain, x.first_bit) for x in out} == want and len(out) == len(cells)
    assert len(written) <= 4


def test_random_cycles_deal_rows_to_more_tasks(spark, monkeypatch):
    from netloom import session

    edges = [[i, i + 1, i + 2, i + 5][: 2 + i % 3] for i in range(60)]
    vertices = spark.range(70).selectExpr("id v", "1L vwt", "cast(null as int) fixed")
    pins = spark.createDataFrame([(e, p) for e, ps in enumerate(edges) for p in ps], "e long, v long")
    h = Hypergraph(vertices, spark.range(60).selectExpr("id e", "id % 3 + 1 hwt"), pins)
    rows = sum(len(ps) * (3 if len(ps) > 3 else 1) for ps in edges)
    rounded = lambda df: sorted((x.src, x.dst, round(x.w, 9), round(x.spread, 9)) for x in df.collect())
    want = rounded(graph.random_cycles(h, 3))
    assert {(a, b) for a, b, *_ in want} == {(b, a) for a, b, *_ in want}
    monkeypatch.setattr(session, "TASK_ROWS", 10, raising=False)
    out = graph.random_cycles(h, 3)
    assert out.rdd.getNumPartitions() == rows // 10 + 1 and rounded(out) == want


def test_neighbours_deal_pairs_to_more_tasks(spark, sf, monkeypatch):
    from netloom.plans import space
    from netloom.plans.registry import QUERIES

    dealt, asked = getattr(space, "dealt", None), []
    monkeypatch.setattr(space, "dealt", lambda df, rows, *keys: asked.append((rows, keys)) or dealt(df, rows, *keys), raising=False)
    QUERIES["topk_neighbors"](spark, sf)
    pins = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey e", "l_partkey v").distinct()
    pairs = pins.groupBy("e").count().selectExpr("sum(count * (count - 1)) n").first().n
    assert set(asked) == {(pairs, ("e",)), (pairs, ("v", "u")), (pairs, ("v",))}


def test_nearest_against_all_pairs(spark):
    from netloom.operators import spatial

    r = random.Random(1)
    points = [(i, r.choice([0.0, r.uniform(0, 1), r.uniform(0, 100)]), r.choice([0.0, r.uniform(0, 1), -r.uniform(0, 60)])) for i in range(150)] + [(500, None, 1.0)]
    queries = [(i, x, y) for i, x, y in points[:40]] + [(900, 5000.0, -3.0), (901, None, None)]
    got = {}
    for x in spatial.k_nearest(spark.createDataFrame(queries, "q long, x double, y double"), spark.createDataFrame(points, "id long, x double, y double"), 4, cell=0.5).collect():
        got.setdefault(x.q, []).append((x.rank, x.id))
    for q, x, y in queries:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in points if a is not None)[:4] if x is not None else []
        assert sorted(got.get(q, [])) == [(k + 1, i) for k, (_, i) in enumerate(near)]


def test_ranges_are_cut_by_structs(spark):
    rows = spark.range(200).select(F.struct((F.col("id") % 7).alias("e"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("root")).alias("g"), "id")
    out = row_numbers(rows, "g", "id", rows=16).orderBy("rn").collect()
    key = lambda i: (i % 7, i % 3 > 0, i % 2 if i % 3 else 0, i)
    assert [r.id for r in out] == sorted(range(200), key=key) and [r.rn for r in out] == list(range(1, 201))


def test_sections_leave_out_hyperedges_of_one_pin(spark):
    v = spark.range(4).selectExpr("id v", "1L vwt", "cast(null as int) fixed")
    pins = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 3), (4, 1), (4, 2), (4, 3)], "e long, v long")
    h = Hypergraph(v, pins.select("e").distinct().withColumn("hwt", F.col("e") * 10), pins)
    rows = partition._gathered(h, spark.range(4).selectExpr("id v", "id div 2 section")).collect()
    assert {r.section: [tuple(p) for p in r.pins] for r in rows} == {0: [(1, 10, 0), (1, 10, 1)], 1: [(4, 40, 2), (4, 40, 3)]}
    parts = {r.v: r.part for r in partition.exact_sections(h, spark.range(4).selectExpr("id v", "0L section"), 0.5).collect()}
    assert parts == {0: 0, 1: 1, 2: 0, 3: 1}


def test_boruvka_keeps_the_direction_of_arcs(spark):
    arcs = spark.createDataFrame([(9, 2, 1), (3, 9, 1), (3, 2, 5)], "src long, dst long, w long")
    label = spark.createDataFrame([(2, 2), (3, 3), (9, 9)], "v long, component long")
    assert {tuple(r) for r in graph.boruvka_step(arcs, label).collect()} == {(2, 9, 2, 1), (3, 3, 9, 1), (9, 3, 9, 1)}


def test_forests_keep_the_direction_of_arcs(spark):
    arcs = spark.createDataFrame([(9, 2, 1), (3, 9, 1), (3, 2, 5), (2, 9, 4), (7, 5, 1)], "src long, dst long, w long")
    v = spark.createDataFrame([(i,) for i in (2, 3, 5, 7, 9)], "v long")
    assert {tuple(r) for r in graph.minimum_spanning_forest(v, arcs, directed=True).collect()} == {(9, 2, 1), (3, 9, 1), (7, 5, 1)}


def test_gains_leave_a_loop_with_its_vertex(spark):
    arcs = [(1, 2, 3), (2, 1, 3), (2, 3, 2), (3, 2, 2), (3, 4, 4), (4, 3, 4), (2, 2, 10)]
    df = spark.createDataFrame(arcs, "src long, dst long, w long")
    label = {1: 1, 2: 1, 3: 3, 4: 3}
    q = lambda of: modularity.modularity(df, spark.createDataFrame(sorted(of.items()), "v long, label long")).first().q
    gains = modularity.move_gains(df, spark.createDataFrame(sorted(label.items()), "v long, label long")).where("v = 2 and target = 3").collect()
    assert gains[0].gain == pytest.approx(q(label | {2: 3}) - q(label))


def test_a_sweep_writes_its_arcs_once_and_never_with_their_needs(spark, monkeypatch):
    """A ladder with a loop behind it and parallel arcs; a table that is written already is not written again."""
    from netloom.operators import graph
    from netloom.session import cut_lineage as real

    pairs = [(i, i + 1, i % 4) for i in range(12)] + [(i, i + 2, 5) for i in range(11)] + [(3, 5, 9), (12, 20, 1), (20, 21, 1), (21, 20, 1)]
    arcs = spark.createDataFrame(pairs, "src long, dst long, delay int").coalesce(2)
    nodes = spark.createDataFrame([(i,) for i in [*range(13), 20, 21, 30]], "node long").coalesce(2)
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    for given, times in ((arcs, 1), (real(arcs), 0)):
        written.clear()
        for late in (True, False):
            got = {r.node: (r.arrival, r.level) for r in graph.sweep(nodes, given, late).collect()}
            want, pick = {30: (0, 0), 0: (0, 0)}, max if late else min
            for v in range(1, 13):
                own = [(s, d) for s, t, d in pairs if t == v]
                want[v] = (pick(want[s][0] + d for s, d in own), 1 + max(want[s][1] for s, _ in own))
            assert got == want
        assert sum("src" in c for c in written) == 2 * times and not any("src" in c and "need" in c for c in written)


def test_both_path_lengths_in_one_pass(spark):
    pairs = spark.createDataFrame([(1, 2, 5), (2, 3, 6)], "src long, dst long, n long")
    at = spark.createDataFrame([(1, [0.0, 4.0]), (2, [2.0, 4.0]), (3, [7.0, 0.0])], "v long, x array<double>")
    got = {tuple(r) for r in graph.path_lengths(pairs, at, both=True).select("src", "dst", "n", "length", "inverse").collect()}
    assert got == {(1, 2, 5, 2.0, 0.5 + 1e9), (2, 3, 6, 9.0, 1 / 5 + 1 / 4)}


def test_links_are_counted_or_sorted_alike():
    import numpy as np

    r = np.random.default_rng(4)
    s, to, k = r.integers(0, 50, 400), r.integers(0, 9, 400) * 5, r.integers(1, 6, 400).astype(float)
    want = {}
    for a, b, x in zip(s.tolist(), to.tolist(), k.tolist(), strict=True):
        want[a, b] = want.get((a, b), 0) + x
    for cells in (0, 4):  # sorted, counted
        v, label, sums = modularity._links(s, to, k, 50, cells)
        assert list(zip(zip(v.tolist(), label.tolist(), strict=True), sums.tolist(), strict=True)) == sorted(want.items())
    none = np.zeros(0, np.int64)
    assert [len(x) for x in modularity._links(none, none, np.zeros(0), 3)] == [0, 0, 0]


def test_batches_of_components_are_tasks_of_their_own(spark, monkeypatch):
    from pyspark import TaskContext

    def whose(pdf, *_):
        return modularity.pd.DataFrame({"v": pdf.src.unique(), "label": TaskContext.get().partitionId(), "q": 0.0})

    monkeypatch.setattr(modularity, "_in_task", whose)
    arcs = spark.range(400).selectExpr("id div 40 * 100 + id % 40 src", "id div 40 * 100 + (id + 1) % 40 dst", "1L w").where("src <> dst")
    both = arcs.unionByName(arcs.selectExpr("dst src", "src dst", "w"))
    label = modularity.communities(both, task_arcs=200)[0].collect()  # ten components of 80 arcs, each over a batch
    assert len({r.label for r in label}) == len({r.v // 100 for r in label}) == 10
