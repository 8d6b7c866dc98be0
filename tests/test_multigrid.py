"""The hierarchy, its V-cycle and the solver against dense algebra on small graphs."""

import random

import numpy as np
import pytest

from netloom.operators import graph, multigrid
from netloom.operators.hypergraph import Hypergraph


def table(spark, edges):
    return spark.createDataFrame([x for a, b, w in edges for x in ((a, b, float(w)), (b, a, float(w)))], "src long, dst long, w double").coalesce(2)


def laplacian(edges, n):
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[a, a] += w
        m[b, b] += w
        m[a, b] -= w
        m[b, a] -= w
    return m


def brute_aggregates(edges, spread):
    """The same clusters by walks over dictionaries."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((w, -min(a, b), -max(a, b), b))
        near.setdefault(b, []).append((w, -min(a, b), -max(a, b), a))
    up = {v: max(x)[3] for v, x in near.items()}
    wide = {v: sum(y[0] for y in x) / max(x)[0] for v, x in near.items()}
    mean = sum(wide.values()) / len(wide)
    parent = {v: None if (up[u] == v and v < u) or wide[v] > spread * mean else u for v, u in up.items()}
    inner = set(parent.values())

    def level(v):
        return 0 if parent[v] is None else 1 + level(parent[v])

    return {v: p if level(v) % 2 else v if p is None or v in inner else parent[p] for v, p in parent.items()}


@pytest.mark.parametrize("spread", [4.0, 0.9])
def test_aggregates_equal_brute_force(spark, spread):
    r = random.Random(2)
    for n in (2, 9, 40):
        edges = [(i, i + 1, r.randint(1, 4)) for i in range(n - 1)] + [(a, b, r.randint(1, 9)) for a, b in {tuple(sorted(r.sample(range(n), 2))) for _ in range(n // 2)} if b - a > 1]
        edges += [(100, v, 3) for v in (101, 102, 103, 104, 105)]  # a star of ties
        got = {x.v: x.cluster for x in multigrid.aggregates(table(spark, edges), spread).collect()}
        assert got == brute_aggregates(edges, spread)


def test_cycle_is_symmetric_and_positive(spark):
    r = random.Random(5)
    n = 24
    edges = [(i, i + 1, r.randint(1, 6)) for i in range(n - 1)] + [(0, 12, 2), (5, 20, 1)]
    h = multigrid.hierarchy(table(spark, edges), coarsest=4)
    assert len(h.levels) >= 3 and h.inverse is not None
    unit = spark.createDataFrame([(v, *[float(v == j) for j in range(n)]) for v in range(n)], "v long, " + ", ".join(f"c{j} double" for j in range(n))).coalesce(2)
    out = {x.v: [x[f"c{j}"] for j in range(n)] for x in h.apply(unit, [f"c{j}" for j in range(n)]).collect()}
    m = np.array([out[v] for v in range(n)])
    assert np.abs(m - m.T).max() < 1e-9 and np.linalg.eigvalsh((m + m.T) / 2).min() > -1e-9
    half = np.linalg.eigvals(m @ laplacian(edges, n)).real
    assert np.sort(half)[1] > 0.1 and half.max() < 1 + 1e-9  # except the constant no vector is far from its solution
    h.close()


def test_solution_and_fewer_rounds_than_the_diagonal(spark):
    n = 30
    edges = [(i, i + 1, 1 + i % 3) for i in range(n - 1)]
    want = np.sin(np.arange(n)) * 5
    b = laplacian(edges, n) @ want
    rhs = spark.createDataFrame([*((v, float(x)) for v, x in enumerate(b)), (500, 0.0)], "v long, b double").coalesce(2)
    arcs = table(spark, [*edges, (700, 701, 2.0)])  # a component without load; 500 has no arc
    levels = multigrid.hierarchy(arcs, coarsest=10)
    out, rounds = multigrid.solve(arcs, rhs, 1e-7, levels=levels)
    x = {r.v: r.x for r in out.collect()}
    assert x[500] == 0 and abs(x[700] - x[701]) < 1e-6
    got = np.array([x[v] for v in range(n)])
    assert np.abs((got - got.mean()) - (want - want.mean())).max() < 1e-4
    _, plain = multigrid.solve(arcs, rhs, 1e-7, multigrid=False, most=rounds + 3)
    assert plain == rounds + 3  # the diagonal isn't there yet


def test_bushy_trees_need_no_rounds(spark):
    """Stars below stars, two components, parallel arcs: leaves go first and the rest is nothing."""
    edges = [(0, v, 1 + v % 3) for v in range(1, 6)] + [(1 + v % 5, v, 2 + v % 4) for v in range(6, 60)] + [(0, 1, 2.0), (100, 101, 4.0)]
    n = 60
    load = np.array([float(v % 7 - 3) for v in range(n)])
    load[0] -= load.sum()
    rhs = spark.createDataFrame([*((v, float(x)) for v, x in enumerate(load)), (100, 2.0), (101, -2.0)], "v long, b double").coalesce(2)
    out, rounds = multigrid.solve(table(spark, edges), rhs, 1e-12)
    x = {r.v: r.x for r in out.collect()}
    assert rounds == 0 and len(x) == n + 2 and abs(x[100] - x[101] - 0.5) < 1e-12
    got = laplacian([e for e in edges if e[0] < n], n) @ np.array([x[v] for v in range(n)])
    assert np.abs(got - load).max() < 1e-9


def test_leaves_of_a_ring_are_eliminated(spark):
    """Only the ring is left for the rounds, and its leaves follow it."""
    n = 40
    edges = [(v, (v + 1) % 10, 1.0 + v % 3) for v in range(10)] + [(v % 10, v, 2.0) for v in range(10, n)]
    want = np.cos(np.arange(n)) * 3
    b = laplacian(edges, n) @ want
    out, rounds = multigrid.solve(table(spark, edges), spark.createDataFrame([(v, float(y)) for v, y in enumerate(b)], "v long, b double").coalesce(2), 1e-9)
    x = {r.v: r.x for r in out.collect()}
    got = np.array([x[v] for v in range(n)])
    assert rounds > 0 and np.abs((got - got.mean()) - (want - want.mean())).max() < 1e-6


def test_empty_graph_and_limits(spark):
    none = table(spark, [(1, 2, 1.0)]).where("false")
    out, rounds = multigrid.solve(none, spark.createDataFrame([(3, 0.0)], "v long, b double"))
    assert rounds == 0 and [(r.v, r.x) for r in out.collect()] == [(3, 0.0)]
    with pytest.raises(ValueError):
        multigrid.hierarchy(none, coarsest=5000)


def test_eigenvectors_converge_sooner(spark):
    n = 40
    vertices = spark.createDataFrame([(i, 1, None) for i in range(n)], "v long, vwt long, fixed int").coalesce(2)
    pins = spark.createDataFrame([(i, i + j) for i in range(n - 1) for j in (0, 1)], "e long, v long").coalesce(2)
    h = Hypergraph(vertices, spark.createDataFrame([(i, 1) for i in range(n - 1)], "e long, hwt long").coalesce(2), pins)
    arcs = graph.cycle_expansion(h)
    levels = multigrid.hierarchy(arcs, coarsest=8)
    # an edge of two pins weighs 1/2 of the path's edge in the Laplacian: (k - 1) / (1 * 1) * (x - mean)
    want = 1 - np.cos(np.pi / n)
    plain = graph.eigenvectors(h, 1, iterations=4).first().value
    near = graph.eigenvectors(h, 1, iterations=4, precondition=levels.apply).first().value
    assert want - 1e-9 <= near < want * 1.01 and near < plain
