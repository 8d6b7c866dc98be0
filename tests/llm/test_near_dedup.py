import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm.components import connected_components
from netloom.llm.minhash import NearDedup, fast_similarity_sketch, near_duplicates
from netloom.llm.textops import Words, chunks, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w)} if w and len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(60, 200))) for _ in range(12)]
    out = [r.choice(base) if r.random() < 0.15 else " ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)]
    for t in base:  # near copies from hardly to heavily edited
        for k in range(10):
            w = t.split()
            for _ in range(k):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += ["", " \t\n", "one", "ONE", "two words", "Two  words", "É x y z", "é x y z"]
    r.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("p", [NearDedup(3, 85, 25, 5, block=16), NearDedup(block=16)])
def test_equals_brute_force(spark, p):
    rows = [*corpus(), (9001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, df, p).collect()}
    assert got == brute(rows, p.words, p.percent)


def hub_corpus(seed=5):
    """Families around hubs: members at Jaccard similarities of 0.40 to 0.60 to the hub, in pairs that are linked with
    each other, and many copies of the hub that make it the best connected member of its buckets."""
    r = random.Random(seed)
    out, n = [], 0

    def fresh(k):
        nonlocal n
        n += k
        return [f"u{n - i}" for i in range(k)]

    for _ in range(6):
        hub = fresh(120)
        out += [" ".join(hub + fresh(2)) for _ in range(12)]
        for share in (0.40, 0.45, 0.5, 0.55, 0.6):
            same = round(120 * 2 * share / (1 + share))
            member = hub[:same] + fresh(120 - same)
            other = [*member]
            other[-3:] = fresh(3)
            out += [" ".join(member), " ".join(other)]
    r.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("p", [NearDedup(3, 85, 25, 5), NearDedup(3, 80), NearDedup(3, 80, block=7, block_shingles=900)])
def test_links_between_members_far_from_their_hub(spark, p):
    rows = hub_corpus()
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), p)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, p.words, p.percent)


def test_the_sketch_filter_keeps_what_the_proof_needs():
    for p in (NearDedup(3, 85, 25, 5), NearDedup()):
        for share in ((100 - 3 * (100 - p.percent)) / 100, p.percent / 100):
            from math import comb

            cut = p.least_alike(share)
            lost = sum(comb(p.bins, x) * share**x * (1 - share) ** (p.bins - x) for x in range(p.bins + 1) if x / p.bins < cut)
            assert lost < 1e-6


def test_tasks_of_a_large_group_are_few(spark):
    """A group of 400 copies with 3 strangers: rows grow with the group, not with its square."""
    from netloom.llm.minhash import _tasks

    members = spark.range(403).selectExpr("5L key", "id v", "if(id < 400, 0, id) comp", "10L size")
    out = _tasks(spark, NearDedup(block=20), members)
    assert out.count() == 403 + 3 * 21 and out.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 60


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "x" * 1_000_000)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (199_996, 1) and out[2] == (199_997, 1) and out[3][1] == 3 and out[4] == (1, 4)


def test_chain_and_hub_far_from_both(spark):
    """Neighbours are linked, ends are not: one component of all."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(20)]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), NearDedup(3, 85, 25, 5, block=4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 85)


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    out = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and sorted((r.doc_id, r.component_id) for r in out if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_similarity_and_fills():
    r = np.random.default_rng(5)
    for shared, own in ((300, 100), (8, 2), (1, 0), (0, 5)):
        a = r.integers(0, 1 << 62, shared + 2 * own).astype(np.uint64)
        x, y = a[: shared + own], np.concatenate([a[:shared], a[shared + own :]])
        doc = np.repeat([0, 1], [len(x), len(y)])
        s = fast_similarity_sketch(doc, np.concatenate([x, y]), 2, 512)
        assert (s != ~np.uint64(0)).all()
        want = shared / (shared + 2 * own)
        assert abs((s[0] == s[1]).mean() - want) < 5 * (0.25 / 512) ** 0.5


def test_components_of_long_chain(spark):
    edges = spark.range(300).selectExpr("id a", "id + 1 b").union(spark.createDataFrame([(1000, 1001), (5, 5), (1001, 1000)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(spark, edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_words_match_the_pattern():
    texts = ["", " a b  c\x0bd", "\x1c x", None, "A" * 600 + " b", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for row, end, offsets, data in chunks(batch, limit=8):
        w = Words(offsets, data)
        assert w.count.tolist() == [len(WORD.findall(t or "")) for t in texts[row:end]]
        doc, _, size = shingle_sets(Words(offsets, data, lower=True), 2)
        assert size.tolist() == [len(shingles(t, 2)) for t in texts[row:end]]


def test_closure_reads_arrow_and_links_strangers():
    import pyarrow as pa

    from netloom.llm.minhash import NearDedup, _closure

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:-1]), "other " * 3 + " ".join(words[20:]), " ".join(words[1:])]
    t = pa.table({"v": [4, 1, 2, 3], "comp": [4, 1, 2, 1], "stranger": [False, False, False, False], "text": texts})
    t = pa.concat_tables([t, pa.table({"v": [4, 2], "comp": [4, 2], "stranger": [True, True], "text": [texts[0], texts[2]]})])
    assert _closure(NearDedup(words=3, percent=85))(t).to_pylist() == [{"a": 4, "b": 1}]
