"""Queries that must take all hyperedges, on a small fixture with wide ones and against brute force."""

import itertools

import pytest

from netloom.plans import catalogue

QUERIES, SQL = catalogue.load()

#: orders of 1 to 6 parts; 1-5 and 6-9 are joined only by orders of three parts and more, 12 by no order
ORDERS = {1: [1, 2, 3], 2: [3, 4, 5, 1], 4: [6, 7, 8], 5: [8, 9, 6, 7], 6: [10, 11], 7: [10], 8: [1, 2, 3, 4, 5, 5]}
PARTS = range(1, 13)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("star")
    spark.createDataFrame([(p, p % 4 + 1) for p in PARTS], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{at}/part.parquet")
    rows = [(o, p, i + 1) for o, ps in ORDERS.items() for i, p in enumerate(ps)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def brute(orders):
    label = {p: p for p in PARTS}
    for _ in PARTS:
        for ps in orders:
            low = min(label[p] for p in ps)
            label |= {p: low for p in ps}
    return label


def test_components_take_all_hyperedges(spark, star):
    want = brute(ORDERS.values())
    got = {r.v: r.component for r in QUERIES["connected_components"](spark, star).collect()}
    assert got == want and set(want.values()) == {1, 6, 10, 12}
    assert {r.v for r in QUERIES["largest_island"](spark, star).collect()} == {1, 2, 3, 4, 5}
    assert {r.v for r in QUERIES["unused_vertices"](spark, star).collect()} == set(PARTS) - {1, 2, 3, 4, 5}


def test_overlay_clusters_take_all_hyperedges(spark, star):
    whole = [ps for ps in ORDERS.values() if all(len({p // s % 2 for p in ps}) == 1 for s in (1, 3))]
    assert {r.v: r.cluster for r in QUERIES["overlay_clusters"](spark, star).collect()} == brute(whole)


def test_colours_differ_in_all_hyperedges(spark, star):
    colour = {r.v: r.colour for r in QUERIES["greedy_colouring"](spark, star).collect()}
    assert set(colour) == {p for ps in ORDERS.values() if len(set(ps)) > 1 for p in ps}
    assert all(colour[a] != colour[b] for ps in ORDERS.values() for a, b in itertools.combinations(sorted(set(ps)), 2))


def shared(orders):
    n = {}
    for ps in orders:
        for pair in itertools.permutations(sorted(set(ps)), 2):
            n.setdefault(pair, []).append(ps)
    return n


def test_neighbours_of_wide_hyperedges(spark, star):
    n = shared(ORDERS.values())
    want = set()
    for v in PARTS:
        best = sorted(((-len(x), u) for (w, u), x in n.items() if w == v))[:5]
        want |= {(v, u, -m, i + 1) for i, (m, u) in enumerate(best)}
    assert {(r.v, r.u, r.n, r.rank) for r in QUERIES["topk_neighbors"](spark, star).collect()} == want


def test_pair_scores_of_wide_hyperedges(spark, sf):
    orders = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r[0], []).append(r[1])
    assert max(len(set(ps)) for ps in orders.values()) > 6
    want = {p: sum(len(ps) / (len(set(ps)) - 1) for ps in x) for p, x in shared(orders.values()).items() if p[0] < p[1]}
    got = {(r.v1, r.v2): r.score for r in QUERIES["heavy_edge_pairs"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-5 for p in want)


def test_multilevel_partition_takes_all_hyperedges(spark, sf, monkeypatch):
    from netloom.operators import partition

    monkeypatch.setattr(partition, "multilevel", lambda h, *_, **__: h.pins)
    pins = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey e", "l_partkey v").distinct()
    assert QUERIES["multilevel_partition"](spark, sf).count() == pins.count()


@pytest.mark.parametrize("skip, merged", [(1000, True), (69, False)])
def test_wide_hyperedges_count_in_coarsening(spark, skip, merged):
    from netloom.operators import partition
    from netloom.operators.hypergraph import Hypergraph

    pins = spark.range(140).selectExpr("id div 70 e", "id v")
    h = Hypergraph(pins.selectExpr("v", "1L vwt", "cast(null as int) fixed"), pins.selectExpr("e", "1L hwt").distinct(), pins)
    clusters = partition.match_heavy(h, partition.Options(thr_coarsen_hyperedge_size_skip=skip))
    assert (clusters.select("cluster").distinct().count() < 140) == merged


def test_sql_of_components_takes_all_hyperedges(star):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{star}/{t}.parquet/*.parquet')")
    assert dict(con.sql(SQL["connected_components"]).fetchall()) == brute(ORDERS.values())
