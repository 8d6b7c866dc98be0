"""Hand-worked values on two small hypergraphs, and invariants."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from netloom.operators import coarsen, cuts, graph, hypergraph, partition, sequential, spatial
from netloom.operators.hypergraph import Hypergraph
from netloom.operators.ordered import prefix_sum, row_numbers
from netloom.sources import sinks, text

SAMPLE = "% comment\n3 5\n1 2\n2 3 5\n\n4 5\n"
TOY = "2 4 11\n10 1 2 3\n5 2 3 4\n10\n10\n9\n7\n"


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("h") / "sample.hgr"
    p.write_text(SAMPLE)
    h = text.read_hgr(spark, str(p))
    return Hypergraph(h.vertices.cache(), h.hyperedges.cache(), h.pins.cache())


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("h") / "toy.hgr"
    p.write_text(TOY)
    return text.read_hgr(spark, str(p))


def parts(spark, values):
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(values)], "v long, part int")


def col(df, key="v"):
    return [r[1] for r in df.orderBy(key).collect()]


def test_degrees_and_hash(sample):
    assert col(hypergraph.pin_degree(sample.pins, sample.vertices)) == [1, 2, 1, 1, 2]
    assert col(hypergraph.hyperedge_hash(sample), "e") == [5, 38, 41]
    assert [(r.first, r.last) for r in hypergraph.pair_list(sample).orderBy("e").collect()] == [(1, 2), (3, 5), (6, 7)]


def test_cut_profile(spark, sample):
    p = parts(spark, [1, 1, 0, 0, 0])
    assert [r.e for r in cuts.cut_edges(sample, p).collect()] == [2]
    assert col(cuts.edge_part(sample, p), "e") == [1, -1, 0]
    assert [r.v for r in cuts.nodes_in_cut_only(sample, p).collect()] == [3]
    assert col(cuts.incident_cut_weight(sample, p)) == [0, 1, 1, 0, 1]
    assert col(cuts.move_gain_free(sample, p)) == [0, 1, 0, 0, 0]
    assert cuts.cut_size(sample, p).first().cut == 1
    assert cuts.evaluate(sample, p, 2, 20).first().feasible
    assert cuts.evaluate(sample, p, 2, 5).first().reason == "balance"


def test_evaluator_reasons(spark, toy):
    e = lambda p, ub: cuts.evaluate(toy, parts(spark, p), 2, ub).first()
    r = e([0, 0, 1, 1], 10)
    assert (r.cut, r.max_block, r.block_limit, r.feasible) == (15, 20, 21.6, True)
    assert e([0, 0, 1, 1], 5).reason == "balance"
    r = e([0, 0, 0, 1], 10)
    assert (r.cut, r.feasible) == (5, False)
    assert e([0, 0, 1], 10).reason == "length"
    assert e([0, 0, 1, -1], 10).reason == "unassigned"
    assert cuts.legacy_cost(cuts.evaluate(toy, parts(spark, [0, 0, 1]), 2, 10)).first().cost == 1e9
    assert col(hypergraph.weighted_degree(toy)) == [10, 15, 15, 5]
    assert col(sequential.first_fit(toy.vertices, 21)) == [0, 0, 1, 1]


def test_coordinates(spark, sample):
    xy = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 4, 3), (5, 2, 1)], "v long, x long, y long")
    assert col(spatial.hpwl(sample.pins, xy), "e") == [4, 8, 4]
    assert [round(x, 6) for x in col(hypergraph.hyperstretch(sample, xy), "e")] == [2.828427, 6.289321, 2.828427]


def test_matvecs(spark, sample):
    x = sample.vertices.select("v", F.col("v").cast("double").alias("x"))
    y = col(graph.laplacian(sample, x))
    assert [round(v, 6) for v in y] == [-0.5, -0.833333, -0.333333, -0.5, 2.166667]
    one = col(graph.laplacian(sample, x.select("v", F.lit(3.0).alias("x"))))
    assert max(map(abs, one)) < 1e-12
    # a unit clique: n x - sum x, scaled by 1 / n in the weighted form
    z = col(graph.clique_matvec(x.withColumn("w", F.lit(1.0))))
    assert [round(v, 9) for v in z] == [-2, -1, 0, 1, 2]
    b = x.withColumn("side", F.expr("case when v in (1, 2) then 1 when v in (4, 5) then 2 end"))
    assert col(graph.biclique_matvec(b)) == [-7, -5, 0, 5, 7]


def test_components_and_isolated(spark, sample):
    assert {r.component for r in graph.connected_components(sample.vertices, sample.pins).collect()} == {1}
    chain = spark.range(1, 200).selectExpr("id e", "explode(array(id, id + 1)) v")
    alone = spark.range(1, 203).withColumnRenamed("id", "v")
    out = {r.v: r.component for r in graph.connected_components(alone, chain).collect()}
    assert set(out.values()) == {1, 201, 202} and out[200] == 1
    lone = Hypergraph(alone.selectExpr("v", "1L vwt", "cast(null as int) fixed"), spark.createDataFrame([], "e long, hwt long"), spark.createDataFrame([], "e long, v long"))
    assert hypergraph.incidence_list(lone).where("size(edges) = 0").count() == 202


def test_contraction_keeps_weight_and_cut(spark, toy):
    c = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "v long, cluster long")
    small = coarsen.contract(toy, c)
    assert small.vertices.agg(F.sum("vwt")).first()[0] == 36
    p = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "v long, part int")
    whole = c.join(p.withColumnRenamed("v", "cluster"), "cluster").select("v", "part")
    assert cuts.cut_size(small, p).first().cut == cuts.cut_size(toy, whole).first().cut == 10


def test_fixed_vertices_survive_coarsening(spark, toy):
    h = text.with_fixed(toy, spark.createDataFrame([(1, 1)], "v long, fixed int"))
    small, ids = coarsen.coarse_filter(h, spark.createDataFrame([(1,), (2,)], "v long"), spark.createDataFrame([], "e long"))
    assert {(r.v, r.new_v) for r in ids.collect()} == {(1, 1), (3, 2), (4, 3)}
    assert small.vertices.where("v = 1").first().fixed == 1


def test_refinement_and_exact(spark, toy):
    o = partition.Options(balance_constraint=10.0)
    start = parts(spark, [0, 1, 0, 1])
    done = partition.refine(toy, start, o)
    assert cuts.cut_size(toy, done).first().cut <= cuts.cut_size(toy, start).first().cut
    best = partition.exact_bipartition(toy, 29)
    assert cuts.cut_size(toy, best).first().cut == 5
    assert {r.part for r in partition.exact_bipartition(toy, 10).collect()} == {-1}
    with pytest.raises(ValueError):
        partition.exact_bipartition(toy, 29, most=3)


def test_multilevel_is_balanced_and_repeatable(spark):
    pins = spark.range(160).selectExpr("id e", "explode(array(id, (id * 7 + 1) % 160, (id + 1) % 160)) v").distinct()
    h = Hypergraph(spark.range(160).selectExpr("id v", "1L vwt", "if(id = 3, 1, null) fixed"), spark.range(160).selectExpr("id e", "1L hwt"), pins)
    o = partition.Options(balance_constraint=5.0, thr_coarsen_vertices=60, refiner_iters=2, num_coarsen_solutions=1, num_initial_solutions=8, num_vcycles=0)
    a, b = (sorted(map(tuple, partition.multilevel(h, o).collect())) for _ in range(2))
    assert a == b and len(a) == 160 and dict(a)[3] == 1
    r = cuts.evaluate(h, spark.createDataFrame(a, "v long, part int"), 2, 5).first()
    assert r.feasible and 0 < r.cut < 160


def random_coarse(seed, o, n=10):
    import numpy as np

    r = np.random.default_rng(seed)
    vertices = [(int(v), int(r.integers(1, 4)), int(v % 2) if v < 2 else None) for v in range(n)]
    pins = [(e, int(r.integers(1, 5)), int(v)) for e in range(12) for v in r.choice(n, r.integers(2, 5), replace=False)]
    cost = {e: w for e, w, _ in pins}
    return partition.Coarse(vertices, [(e, cost[e], v) for e, _, v in pins], o, 0.6 * sum(w for _, w, _ in vertices))


def test_coarse_search_against_all_bipartitions():
    """The exact search finds the least cut of all, refined starts are never below it and mostly reach it."""
    import itertools

    import numpy as np

    o = partition.Options(refiner_iters=5)
    reached = 0
    for seed in range(12):
        g = random_coarse(seed, o)
        every = (np.array(x) for x in itertools.product((0, 1), repeat=10))
        least = min(g.cut(x) for x in every if g.fits(x) and x[0] == 0 and x[1] == 1)
        assert g.cut(g.exact(g.most)) == least
        found = [g.refine(g.start(i)) for i in range(8)]
        assert all(g.cut(x) >= least for x in found if g.fits(x)) and all(x[0] == 0 and x[1] == 1 for x in found)
        reached += min(g.cut(x) for x in found) == least
    assert reached >= 10


def test_options_of_the_search_have_effect():
    from dataclasses import replace

    o = partition.Options()
    g = random_coarse(3, replace(o, max_moves=0), 40)
    start = g.start(0)
    assert (g.refine(start) == start).all() and (random_coarse(3, replace(o, refiner_iters=0), 40).refine(start) == start).all()
    better = random_coarse(3, o, 40)
    assert better.cut(better.refine(start)) < g.cut(start)
    eager = random_coarse(3, replace(o, early_stop_ratio=0.0, refiner_iters=1), 40)
    assert eager.cut(eager.refine(start)) >= random_coarse(3, replace(o, early_stop_ratio=1.0, refiner_iters=1), 40).cut(random_coarse(3, replace(o, early_stop_ratio=1.0, refiner_iters=1), 40).refine(start))
    assert g.exact(g.most, start, steps=1) is start


def test_options_of_coarsening_have_effect(spark, toy):
    pins = spark.range(60).selectExpr("id div 2 e", "id v")
    h = Hypergraph(pins.selectExpr("v", "1L vwt", "cast(null as int) fixed"), pins.selectExpr("e", "1L hwt").distinct(), pins)
    left = lambda ratio: partition.match_heavy(h, partition.Options(coarsening_ratio=ratio)).select("cluster").distinct().count()
    assert left(2.5) == 30 and 40 <= left(1.2) < 60
    inside = h.vertices.selectExpr("v", "cast(v % 2 as int) part")
    assert partition.match_heavy(h, partition.Options(), inside).where("v <> cluster").count() == 0
    paths = spark.createDataFrame([(1, -2.0, 1), (1, -2.0, 2), (2, -1.0, 2), (3, 5.0, 3)], "path long, slack double, e long")
    heavy = {r.e: r.hwt for r in partition.with_critical_paths(toy, paths, partition.Options(top_n=2)).hyperedges.collect()}
    plain = {r.e: r.hwt for r in toy.hyperedges.collect()}
    assert heavy == {e: w * {1: 2, 2: 3}.get(e, 1) for e, w in plain.items()} and {1, 2} <= set(plain)


def test_a_vcycle_never_worsens(spark, sample):
    o = partition.Options(balance_constraint=20.0, thr_coarsen_vertices=2, refiner_iters=2)
    start = partition.greedy_blocks(sample, o, 1)
    before, after = (cuts.cut_size(sample, p).first().cut for p in (start, partition.vcycle(sample, start, o)))
    assert after <= before


def test_cycles_in_trees_and_arcs_raise(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), *((i, i - 1 if i > 10 else None) for i in range(10, 30))], "node long, parent long")
    for f in (graph.ancestors, graph.tree_levels, graph.euler_tour):
        with pytest.raises(ValueError, match="cycle"):
            f(ring)
    arcs = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "b", 1)], "src string, dst string, delay long")
    with pytest.raises(ValueError, match="cycle"):
        graph.propagate(spark.createDataFrame([(c,) for c in "abc"], "node string"), arcs)


def test_long_chains_keep_one_row_a_node(spark):
    chain = spark.range(200).selectExpr("id node", "if(id > 0, id - 1, null) parent")
    assert {tuple(r) for r in graph.tree_levels(chain).where("node in (0, 7, 199)").collect()} == {(0, 0), (7, 7), (199, 199)}
    q = spark.createDataFrame([(199, 3), (50, 120)], "a long, b long")
    assert {tuple(r) for r in graph.lowest_common_ancestors(chain, q).collect()} == {(199, 3, 3), (50, 120, 50)}


def test_many_ranges(monkeypatch, spark):
    from netloom.operators import ordered

    df = spark.range(3000).selectExpr("(id * 7) % 1009 k", "id")
    monkeypatch.setattr(ordered, "NESTED", 3)
    part = ordered.ranged(df, "k", rows=40).groupBy("part").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("part").collect()
    assert len(part) > 50 and all(a.hi <= b.lo for a, b in zip(part, part[1:], strict=False))
    assert [r.rn for r in ordered.row_numbers(df, "k", "id", rows=40).orderBy("k", "id").collect()] == list(range(1, 3001))


def test_one_key_value_is_many_parts(spark):
    """Equal keys are cut by the ties, equal ties by the other columns; nulls come first."""
    from netloom.operators import ordered

    df = spark.range(4200).selectExpr("if(id < 100, null, 5L) k", "id % 3 tie", "id x").repartition(7)
    own = ordered.ranged(df, "k", "tie", rows=1000)
    sizes = [r["count"] for r in own.groupBy("part").count().collect()]
    assert len(sizes) > 3 and max(sizes) <= 2000
    rows = ordered.prefix_sum(df, "k", "x", "tie", rows=500).collect()
    assert sorted(r.total for r in rows)[-1] == sum(range(4200)) and {r.x for r in rows if r.k is None} == {r.x for r in sorted(rows, key=lambda r: r.total)[:101] if r.x < 100}
    got = ordered.group_row_numbers(df.where("k is not null"), "tie", "x", rows=300).collect()
    assert all(r.rn == sum(1 for y in range(100, r.x + 1) if y % 3 == r.tie) for r in got) and len(got) == 4100
    text = spark.range(3000).selectExpr("concat('n', id % 5) k", "id")
    assert sorted(r.rn for r in ordered.row_numbers(text, "k", "id", rows=100).collect()) == list(range(1, 3001))


def brute_colours(edges):
    colour = {}
    for v in sorted({v for e in edges for v in e}):
        used = {colour[u] for e in edges if v in e for u in e if u < v}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
    return colour


@pytest.mark.parametrize("block", [3, 40, 1 << 18])
def test_colours_of_many_blocks(spark, block):
    import random

    r = random.Random(6)
    edges = [set(r.sample(range(120), r.choice([1, 2, 3, 5, 9]))) for _ in range(130)] + [set(range(40, 70))]
    pins = spark.createDataFrame([(i, v) for i, e in enumerate(edges) for v in [*e, min(e)]], "e long, v long")
    assert {x.v: x.colour for x in sequential.greedy_colouring(pins, block).collect()} == brute_colours(edges)
    assert sequential.greedy_colouring(pins.limit(0)).count() == 0


def test_components_are_coloured_without_rounds(spark, monkeypatch):
    import random

    def refuse(*_):
        raise AssertionError("rounds over blocks")

    monkeypatch.setattr(sequential, "_by_blocks", refuse)
    r = random.Random(7)
    edges = [{50 * i + v for v in r.sample(range(50), r.choice([1, 2, 3, 6]))} for i in range(6) for _ in range(30)]
    pins = spark.createDataFrame([(i, v) for i, e in enumerate(edges) for v in e], "e long, v long")
    assert {x.v: x.colour for x in sequential.greedy_colouring(pins, 50).collect()} == brute_colours(edges)


def test_components_of_unlisted_vertices_and_long_chains(spark):
    pins = spark.createDataFrame([(i, v) for i in range(40) for v in ((i * 17) % 41, ((i + 1) * 17) % 41)] + [(90, 70), (90, 71), (91, 71), (91, 72), (None, 70), (None, 3)], "e long, v long")
    vertices = spark.createDataFrame([(v,) for v in [*range(41), 70, 72, 80]], "v long")  # 71 isn't listed
    want = {v: 0 for v in range(41)} | {v: v for v in (70, 72, 80)}
    assert {r.v: r.component for r in graph.connected_components(vertices, pins).collect()} == want


@pytest.mark.parametrize("capacity", [0, 1, 60, 777, 2500, 10_000])
def test_first_fit_by_rounds(spark, capacity):
    import random

    r = random.Random(capacity)
    weights = [r.choice([0, 1, 2, 5, 40, 300]) for _ in range(400)]
    area, want = 0, {}
    for i, w in enumerate(weights):
        want[i] = int(not area + w < capacity)
        area += w if not want[i] else 0
    df = spark.createDataFrame(list(enumerate(weights)), "v long, vwt long")
    assert {x.v: x.part for x in sequential.first_fit(df, capacity, rows=30).collect()} == want


def test_trees(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (9, None)], "node long, parent long")
    assert {tuple(r) for r in graph.tree_levels(tree).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (9, 0)}
    q = spark.createDataFrame([(4, 5), (4, 3), (4, 9)], "a long, b long")
    assert {tuple(r) for r in graph.lowest_common_ancestors(tree, q).collect()} == {(4, 5, 2), (4, 3, 1), (4, 9, None)}
    assert [r.node for r in graph.euler_tour(tree).where("root = 1").orderBy("pos").collect()] == [1, 2, 4, 2, 5, 2, 1, 3, 1]


def test_levels_loops_and_colours(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(c,) for c in "abcxy"], "node string")
    assert {tuple(r) for r in graph.levelize(nodes, arcs).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None)}
    ring = spark.createDataFrame([(i, v) for i, arc in enumerate([(1, 2), (2, 3), (3, 1), (3, 4)]) for v in arc], "e long, v long")
    assert {r.v: r.colour for r in sequential.greedy_colouring(ring).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


def test_spanning_forest(spark):
    arcs = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (1, 3, 3), (4, 5, 1)], "src long, dst long, w long")
    v = spark.range(1, 7).withColumnRenamed("id", "v")
    assert {tuple(r) for r in graph.minimum_spanning_forest(v, arcs).collect()} == {(1, 2, 1), (2, 3, 2), (4, 5, 1)}
    assert graph.minimum_spanning_forest(v, arcs.where("false")).count() == 0
    assert graph.minimum_spanning_forest(v.where("v > 1"), arcs).count() == 2


def test_spanning_forest_equals_kruskal(spark):
    import random

    r = random.Random(7)
    rows = [(*r.sample(range(40), 2), r.randint(1, 4)) for _ in range(90)]  # ties, repeats, both directions
    label, want = list(range(40)), set()
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in rows):
        if label[a] != label[b]:
            want.add((a, b, w))
            label = [label[a] if x == label[b] else x for x in label]
    arcs = spark.createDataFrame(rows, "src long, dst long, w long").coalesce(2)
    got = graph.minimum_spanning_forest(spark.range(40).withColumnRenamed("id", "v"), arcs).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_prim_dijkstra(spark):
    rows = [(1, i, x, y, i == 0) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (10, 10)])] + [(2, 0, 5, 5, True)]
    net = spark.createDataFrame(rows, "net long, pin long, x long, y long, driver boolean")
    out = graph.prim_dijkstra(net, 0.4).groupBy("net").agg(F.sum("length").alias("l"), F.max("depth").alias("d"))
    assert {tuple(r) for r in out.collect()} == {(1, 20.0, 20.0), (2, 0.0, 0.0)}


def test_eigenvectors(spark, sample):
    out = graph.eigenvectors_dense(sample, 2).collect()
    x = {k: {r.v: r.x for r in out if r.k == k} for k in (1, 2)}
    y = graph.laplacian(sample, spark.createDataFrame(sorted(x[1].items()), "v long, x double"))
    value = next(r.value for r in out if r.k == 1)
    assert all(abs(r.y - value * x[1][r.v]) < 1e-9 for r in y.collect())
    assert abs(sum(x[1][v] * x[2][v] for v in x[1])) < 1e-9
    with pytest.raises(ValueError):
        graph.eigenvectors_dense(sample, 1, most=2)


def test_block_iterations_equal_a_dense_solution(spark):
    import random

    import numpy as np

    r, n = random.Random(3), 14
    edges = [[i, i + 1] for i in range(n - 1)] + [r.sample(range(n), r.randint(2, 5)) for _ in range(12)]
    vertices = spark.createDataFrame([(i, 1 + i % 3, None) for i in range(n)], "v long, vwt long, fixed int")
    pins = spark.createDataFrame([(e, p) for e, ps in enumerate(edges) for p in ps], "e long, v long").coalesce(2)
    h = Hypergraph(vertices, spark.createDataFrame([(e, 1 + e % 4) for e in range(len(edges))], "e long, hwt long"), pins)
    m, w = np.zeros((n, n)), np.array([1 + i % 3 for i in range(n)], float)
    for e, ps in enumerate(edges):
        k = len(ps)
        m[np.ix_(ps, ps)] += (1 + e % 4) * (k - 1) / ((k // 2) * ((k + 1) // 2)) * (np.eye(k) - 1 / k)
    value, vec = np.linalg.eigh(m / np.sqrt(np.outer(w, w)))
    out = graph.eigenvectors(h, 1, iterations=25).collect()
    x = np.array([r.x for r in sorted(out, key=lambda r: r.v)])
    assert abs(out[0].value - value[1]) < 1e-3 * value[1]
    assert abs(abs(x @ (np.sqrt(w) * vec[:, 1])) - 1) < 1e-2 and abs(w @ x) < 1e-9 and abs(w @ (x * x) - 1) < 1e-9


def test_vectors_of_several_components_are_exact(spark, monkeypatch):
    """Two cycles and an isolated vertex: value 0, constant on each, orthonormal under the weights, no iterations."""
    import numpy as np

    vertices = spark.createDataFrame([(i, 1 + i % 3, None) for i in range(9)], "v long, vwt long, fixed int")
    edges = [(i, (i + 1) % 4) for i in range(4)] + [(4 + i, 4 + (i + 1) % 4) for i in range(4)]
    pins = spark.createDataFrame([(e, p) for e, ps in enumerate(edges) for p in ps], "e long, v long")
    h = Hypergraph(vertices, spark.createDataFrame([(e, 1) for e in range(8)], "e long, hwt long"), pins)
    monkeypatch.setattr(graph, "_laplacians", None)
    out = graph.eigenvectors(h, 2).collect()
    assert len(out) == 18 and {r.value for r in out} == {0.0} and {r.k for r in out} == {1, 2}
    w = np.array([1 + i % 3 for i in range(9)], float)
    x = np.array([[r.x for r in sorted(out, key=lambda r: r.v) if r.k == k] for k in (1, 2)])
    assert all(len(set(v[part].tolist())) == 1 for v in x for part in (slice(0, 4), slice(4, 8)))
    assert np.abs(x @ w).max() < 1e-9 and np.abs((x * w) @ x.T - np.eye(2)).max() < 1e-9
    assert all(v[np.abs(v).argmax()] > 0 for v in x)


def test_placement_solved_to_tolerance(spark):
    import numpy as np

    edges = [(0, 1, 2.0), (1, 2, 1.0), (2, 3, 4.0), (3, 4, 1.0), (1, 3, 0.5), (4, 5, 3.0)]
    arcs = spark.createDataFrame([x for a, b, w in edges for x in ((a, b, w), (b, a, w))], "src long, dst long, w double")
    x = spark.createDataFrame([(v, 10.0 if v == 5 else 0.0) for v in range(7)], "v long, x double")  # 6 has no arc
    out = {r.v: r.x for r in graph.solve_quadratic(arcs, x, spark.createDataFrame([(0,), (5,)], "v long"), 1e-9).collect()}
    m = np.zeros((6, 6))
    for a, b, w in edges:
        m[a, a] += w
        m[b, b] += w
        m[a, b] -= w
        m[b, a] -= w
    want = np.linalg.solve(m[1:5, 1:5], -m[1:5, 5] * 10)
    assert out[0] == 0 and out[5] == 10 and out[6] == 0 and all(abs(out[v] - want[v - 1]) < 1e-6 for v in range(1, 5))


def test_communities_by_method(spark):
    arcs = spark.createDataFrame([x for a, b in ((1, 2), (2, 3), (7, 8)) for x in ((a, b, 1), (b, a, 1))], "src long, dst long, w long")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "v long")
    assert {r.v: r.label for r in graph.communities(arcs, v, "components").collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    label = {r.v: r.label for r in graph.communities(arcs, v, rounds=2).collect()}
    assert set(label) == {1, 2, 3, 7, 8, 9} and label[9] == 9 and label[7] in (7, 8) and label[1] in (1, 2, 3)
    with pytest.raises(ValueError):
        graph.communities(arcs, v, "none")


def test_alpha_of_single_nets(spark):
    """Shortest paths for one net, a minimum spanning tree for the other of the same pins."""
    pins = [(0, 0, 0, True), (1, 4, 0, False), (2, 4, 3, False), (3, 0, 4, False)]
    nets = spark.createDataFrame([(net, *p) for net in (1, 2) for p in pins], "net long, pin long, x long, y long, driver boolean")
    out = graph.prim_dijkstra(nets, 0.0, spark.createDataFrame([(2, 1.0)], "net long, alpha double"))
    total = {r.net: (r.length, r.depth) for r in out.groupBy("net").agg(F.sum("length").alias("length"), F.max("depth").alias("depth")).collect()}
    assert total[1][0] <= total[2][0] and total[2][1] == 7.0


def test_ranged_prefix_sums_cross_parts(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 k", "id % 5 x")
    out = prefix_sum(df, "k", "x", rows=50).orderBy("k").collect()
    total = 0
    for r in out:
        total += r.x
        assert r.total == total
    ties = spark.createDataFrame([(None, 1), (2, 3), (2, 2), (2, 1), (1, 9)], "k long, t long")
    assert [(r.k, r.t) for r in row_numbers(ties, "k", "t", rows=1).orderBy("rn").collect()] == [(None, 1), (1, 9), (2, 1), (2, 2), (2, 3)]
    assert row_numbers(ties.where("k > 5"), "k").count() == 0


def test_hgr_round_trip(spark, toy, tmp_path):
    sinks.write_hgr(toy, str(tmp_path / "out"))
    back = text.read_hgr(spark, str(tmp_path / "out"))
    for name in ("vertices", "hyperedges", "pins"):
        a, b = getattr(toy, name), getattr(back, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert "\n".join(r.line for r in sinks.hgr_lines(toy).orderBy("kind", "id").collect()) + "\n" == TOY


def test_bad_hgr(spark, tmp_path):
    for name, body in (("short", "3 5\n1 2\n"), ("range", "1 2\n1 3\n"), ("none", "")):
        (tmp_path / name).write_text(body)
        with pytest.raises(ValueError):
            text.read_hgr(spark, str(tmp_path / name))
    assert text.read_hgr(spark, str(tmp_path / "range"), permissive=True).pins.count() == 1
    (tmp_path / "lfs").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")
    with pytest.raises(ValueError):
        text.reject_pointer(text.numbered_lines(spark, str(tmp_path / "lfs"))).count()


def test_best_prefix_of_moves_against_all_prefixes(spark):
    import random

    r = random.Random(2)
    for seed in range(3):
        hyper = [(r.sample(range(18), r.choice([2, 3, 4])), r.randint(1, 4)) for _ in range(25)]
        part = {v: r.randrange(2) if seed < 2 else v % 3 for v in range(18)}
        run = r.sample([v for v in part if part[v] == 0], 5)
        cut = lambda p: sum(w for vs, w in hyper if len({p[v] for v in vs}) > 1)  # noqa: B023, E731
        tried = [cut(part | dict.fromkeys(run[:k], 1)) for k in range(len(run) + 1)]
        h = Hypergraph(
            spark.createDataFrame([(v, 1, None) for v in part], "v long, vwt long, fixed int"), spark.createDataFrame([(e, w) for e, (_, w) in enumerate(hyper)], "e long, hwt long"),
            spark.createDataFrame([(e, v) for e, (vs, _) in enumerate(hyper) for v in vs], "e long, v long"),
        )
        got = partition._best_prefix(h, spark.createDataFrame(list(part.items()), "v long, part int"), spark.createDataFrame([(v, i + 1) for i, v in enumerate(run)], "v long, rn long"), 0, 1, tried[0])
        if min(tried) == tried[0]:
            assert got is None
        else:
            k = tried.index(min(tried))
            assert got[1] == min(tried) and {x.v: x.part for x in got[0].collect()} == part | dict.fromkeys(run[:k], 1)


def test_rising_moves_are_the_positive_gains(spark):
    """From one row a hyperedge, also for three parts and hyperedges of one pin."""
    import random

    r = random.Random(5)
    for k in (2, 3):
        hyper = [(r.sample(range(30), r.choice([1, 2, 2, 3, 4])), r.randint(1, 4)) for _ in range(45)]
        h = Hypergraph(
            spark.createDataFrame([(v, 1, None) for v in range(30)], "v long, vwt long, fixed int"), spark.createDataFrame([(e, w) for e, (_, w) in enumerate(hyper)], "e long, hwt long"),
            spark.createDataFrame([(e, v) for e, (vs, _) in enumerate(hyper) for v in vs], "e long, v long"),
        )
        parts = spark.createDataFrame([(v, v % k) for v in range(30)], "v long, part int")
        want = {tuple(x) for x in cuts.kway_gain(h, parts).where("gain > 0").collect()}
        assert want and {tuple(x) for x in cuts.rising_moves(h, cuts.spread(h, parts)).collect()} == want


def test_starts_are_proven_or_not_and_bounds_are_options(spark, toy):
    o = partition.Options(balance_constraint=32.0, num_initial_solutions=4, num_best_initial_solutions=2)
    assert all(x.proven and x.cut == 5 for x in partition.search_starts(toy, o).collect())
    assert not any(x.proven for x in partition.search_starts(toy, partition.Options(balance_constraint=30.0, num_initial_solutions=2, exact_steps=1)).collect())
    assert all(x.proven for x in partition.search_starts(toy, partition.Options(balance_constraint=30.0, num_initial_solutions=2, exact_steps=0)).collect())
    with pytest.raises(ValueError, match="most_coarse_pins"):
        partition.multilevel(toy, partition.Options(most_coarse_pins=3))
    with pytest.raises(ValueError, match="unknown start"):
        partition.multilevel(toy, partition.Options(start="x"))


def test_best_of_many_solutions_keeps_a_row_a_pin(spark):
    r = random.Random(8)
    pins = sorted({(e, r.randrange(12)) for e in range(30) for _ in range(3)})
    part = {(s, v): r.randrange(3) for s in range(40) for v in range(12)}
    h = Hypergraph(spark.range(12).selectExpr("id v", "1L vwt", "cast(null as int) fixed"), spark.range(30).selectExpr("id e", "id % 4 + 1 hwt"), spark.createDataFrame(pins, "e long, v long"))
    out = cuts.best_of(h, spark.createDataFrame([(s, v, p) for (s, v), p in part.items()], "solution long, v long, part int"), 35)
    cut = lambda s: sum(e % 4 + 1 for e in range(30) if len({part[s, v] for d, v in pins if d == e}) > 1)
    assert [tuple(x) for x in out.collect()] == sorted(((s, cut(s)) for s in range(40)), key=lambda x: (x[1], x[0]))[:35]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [v" in plan and "BroadcastHashJoin [v" not in plan


def test_either_start_takes_rounds_beyond_the_bound(spark, toy):
    o = partition.Options(most_coarse_pins=3, start="either", num_coarsen_solutions=1, num_vcycles=0, num_best_initial_solutions=2, refiner_iters=2, balance_constraint=20)
    parts = partition.multilevel(toy, o).collect()
    assert len(parts) == toy.vertices.count() and {r.part for r in parts} <= {0, 1}


def test_start_of_the_query_is_one_for_every_size(spark, monkeypatch):
    r = random.Random(5)
    pins = sorted({(e, r.randrange(60)) for e in range(120) for _ in range(3)})
    h = Hypergraph(spark.range(60).selectExpr("id v", "id % 3 + 1 vwt", "if(id = 7, 1, null) fixed"), spark.range(120).selectExpr("id e", "id % 4 + 1 hwt"), spark.createDataFrame(pins, "e long, v long"))
    monkeypatch.setattr(partition, "best_start", None)  # nothing is sent whole to a task
    o = partition.Options(start="either", num_initial_solutions=4, num_best_initial_solutions=2, refiner_iters=1, balance_constraint=6)
    out = [sorted(map(tuple, partition._start(h, replace(o, most_coarse_pins=n)).collect())) for n in (1, 10**6)]
    assert out[0] == out[1] and len(out[0]) == 60 and dict(out[0])[7] == 1
    # the best of the best two of all four starts
    starts = [partition.cut_lineage(partition.greedy_blocks(h, o, o.seed + i)) for i in range(4)]
    assert {tuple(x) for x in partition.starts(h, o, o.seed, 4).collect()} == {(i, *x) for i, p in enumerate(starts) for x in p.collect()}
    over = lambda p: not cuts.evaluate(h, p, 2, 6).first().feasible
    kept = sorted((over(p), partition._cut(h, p), i) for i, p in enumerate(starts))[:2]
    done = {i: partition.refine(h, starts[i], o) for _, _, i in kept}
    best = min((over(p), partition._cut(h, p), i) for i, p in done.items())[2]
    assert out[0] == sorted(map(tuple, done[best].collect()))


def test_rounds_search_exactly_on_few_vertices(spark, toy):
    o = partition.Options(start="rounds", balance_constraint=32.0, num_initial_solutions=4, num_best_initial_solutions=2, num_coarsen_solutions=1, num_vcycles=0)
    assert cuts.cut_size(toy, partition._start(toy, o)).first().cut == 5
