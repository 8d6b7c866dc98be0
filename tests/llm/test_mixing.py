import collections
import random

import pytest

from netloom.llm import mixing


def corpus(n=400):
    r = random.Random(7)
    names = ["a", "B", "é", None, "zz", "", "tiny", "none"]
    rows = []
    for i in range(n):
        source = "zz" if i % 3 == 0 else names[r.randrange(6)]
        rows.append((i, source, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 300])))))
    return [*rows, (n, "tiny", "x y"), (n + 1, "none", ""), (n + 2, "none", None), (None, "a", "u v"), (None, "a", "u v"), (5, "B", "again and again"), (5, "B", "again and again")]


def brute_targets(sizes, weights, total, epochs):
    """By the definition: share, bound, share the excess again."""
    bound, free = {}, set(sizes)
    while True:
        left, units = total - sum(bound.values()), sum(weights[s] for s in free)
        over = {s for s in free if units and epochs * sizes[s] <= weights[s] * left / units}
        if not over:
            return {s: bound[s] if s in bound else weights[s] * left / units for s in sizes}
        bound |= {s: epochs * sizes[s] for s in over}
        free -= over


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, source string, text string").selectExpr("*", "1 size", "2 key", "3 n", "4 range", "5 number", "6 start", "7 k")
    return mixing.mix(spark, df.repartition(5), (5, 2, 1)).collect()


def test_targets_and_totals(mixed):
    rows = corpus()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = brute_targets(sizes, weights, sum(sizes.values()), 3)
    assert len(mixed) == len(rows)
    taken = collections.Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s]), s
    assert sorted(map(str, ((r.doc_id, r.source, r.size) for r in mixed))) == sorted(map(str, ((i, s, len((t or "").split())) for i, s, t in rows)))


def test_each_source_is_cut_once_in_whole_passes(mixed):
    by = collections.defaultdict(list)
    for r in mixed:
        if r.size:
            by[r.source].append(r)
    for rows in by.values():
        passes = int(rows[0].target) // rows[0].source_size
        partial = [r for r in rows if r.taken not in (passes * r.size, (passes + 1) * r.size)]
        assert len(partial) <= 1


def test_reruns_and_ranges_agree(spark, mixed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    df = spark.createDataFrame(corpus()[::-1], "doc_id long, source string, text string").repartition(3)
    again = mixing.mix(spark, df, (5, 2, 1)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_weights_table_and_total(spark):
    rows = [(1, "a", "x " * 10), (2, "b", "x " * 100), (3, "c", "x " * 50), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1), ("b", 1), (None, None)], "source string, weight int")
    out = {r.doc_id: (r.target, r.taken) for r in mixing.mix(spark, df, weights, total=100, epochs=2).collect()}
    assert out == {1: (20.0, 20), 2: (80.0, 80), 3: (0.0, 0), 4: (0.0, 0)}
    out = {r.doc_id: r.taken for r in mixing.mix(spark, df, weights, total=10_000, epochs=2).collect()}
    assert out == {1: 20, 2: 200, 3: 0, 4: 0}


def test_empty(spark):
    assert mixing.mix(spark, spark.createDataFrame([], "doc_id long, source string, text string"), (5, 2, 1)).count() == 0


def test_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc"), (2, "d e"), (3, "f")], "doc_id long, text string")
    plan = spark.createDataFrame([(1, 3, 5), (2, 2, 2), (3, 1, 0)], "doc_id long, size long, taken long")
    out = sorted((r.doc_id, r.epoch, r.text) for r in mixing.repeat_texts(docs, plan).collect())
    assert out == [(1, 0, "a  b\nc"), (1, 1, "a b"), (2, 0, "d e")]
