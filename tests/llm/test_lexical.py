import collections
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    split = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in split if c), sum(c.total() for _, c in split)
    df = collections.Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in split:
            m = 25 + 75 * c.total() * n_docs // total if total else 0
            s = sum(int(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(n=300):
    r = random.Random(3)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 500}"
    docs = [(1000 - i, " ".join(word() for _ in range(r.randrange(60)))) for i in range(n)]
    docs += [(5, "Ünïcode ÄB äb 漢字 x_y x-y"), (6, ""), (7, None), (8, "..."), (None, "w1 w2 rare"), (None, "w1 w2 rare"), (11, docs[0][1]), (11, docs[0][1]), (12, "big " * 40_000 + "rare"), (13, "A" * 3000)]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 30)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "?!"), (93, "unknownterm"), (94, "ünïcode Äb 漢字"), (95, "rare rare big"), (None, "w1 w2"), (95, "w3"), (96, "a" * 3000)]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 term", "2 shard", "3 df").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 item", "2 term", "3 body", "4 doc_id", "5 score")
    for size, block in ((16 << 20, 1000), (3000, 7)):
        monkeypatch.setattr(lexical, "SHARD_BYTES", size)
        monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
        index = lexical.build(spark, a)
        got = sorted((tuple(r) for r in lexical.search(spark, index, b).collect()), key=str)
        assert got == brute(docs, items)


def test_empty_tables_and_other_k(spark):
    docs, items = corpus(50)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(spark, a)
    assert sorted((tuple(r) for r in lexical.search(spark, index, b, k=3).collect()), key=str) == brute(docs, items, 3)
    assert lexical.search(spark, index, b.limit(0)).count() == 0
    assert lexical.search(spark, lexical.build(spark, a.limit(0)), b).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 6), min_size=1, max_size=31), max_size=9), st.integers(1, 5))
def test_merge_equals_sums(lists, k):
    total = collections.Counter()
    for x in lists:
        total.update(x)
    want = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]
    made = [lexical._List(sorted(x), [x[d] for d in sorted(x)], max(x.values())) for x in lists]
    assert lexical.best(made, k) == want


@given(st.lists(st.integers(0, (1 << 62) - 1)))
def test_codes(values):
    raw, at = lexical.encode(np.array(values, np.int64))
    assert lexical.decode(raw.tobytes()).tolist() == values and len(at) == len(values) + 1
