import collections
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm.substrings import SuffixAutomaton, covered, cut, remove_reference, remove_repeats


def brute(rows, words):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + words]) for _, w in split for k in range(len(w) - words + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - words + 1):
            if count[tuple(w[k : k + words])] > 1:
                gone[k : k + words] = [True] * words
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def corpus():
    r = random.Random(4)
    word = lambda: f"w{r.randrange(3000)}"
    passages = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(40):
        t = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            t.insert(r.randint(0, len(t)), r.choice(passages))
        rows.append((i, " ".join(t)))
    rows += [(100, "again " * 90), (101, "x y " * 40), (102, "p " + "q r s " * 15), (103, rows[3][1]), (104, ""), (105, None), (106, "a" * 5000), (107, passages[4] + "\n\n" + passages[4])]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' th", "1 m", "2 spans").repartition(5)
    out = remove_repeats(spark, df, words=35)
    got = sorted((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").encode().decode().split())) for r in out.collect())
    assert got == brute(rows, 35)


def test_untouched_texts_stay_as_they_are(spark):
    rows = [(1, "  a\tb\n\nc "), (2, "z " * 10 + "\n end")]
    out = {r.doc_id: r.text for r in remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=20).collect()}
    assert out == dict(rows)


def test_repeated_rows_and_carried_columns(spark):
    t = " ".join(f"u{i}" for i in range(50))
    df = spark.createDataFrame([(1, t, "en"), (1, t, "en"), (2, "b", None)], "doc_id long, text string, lang string")
    out = remove_repeats(spark, df, words=35, carry=("lang",)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed, r.lang) for r in out] == [(1, 50, "en"), (1, 50, "en"), (2, 0, None)]
    assert remove_repeats(spark, df.limit(0), words=35).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=4), st.lists(st.sampled_from("abcd"), max_size=20))
def test_matching_statistics(sequences, text):
    found = SuffixAutomaton(sequences).matching_statistics(text)
    for i, size in enumerate(found):
        inside = lambda n: any(text[i + 1 - n : i + 1] == s[k : k + n] for s in sequences for k in range(len(s) - n + 1))
        assert size == max([n for n in range(i + 2) if n == 0 or inside(n)])
    assert covered(found, 2).tolist() == [any(found[j] >= 2 and j - found[j] < i <= j for j in range(i, len(text))) for i in range(len(text))]


def test_reference_shards(spark, monkeypatch):
    import netloom.llm.substrings as s

    monkeypatch.setattr(s, "MAX_SHARD_WORDS", 30)
    words = [f"r{i}" for i in range(200)]
    ref = spark.createDataFrame([(" ".join(words[k : k + 40]),) for k in range(0, 160, 40)] + [(None,)], "text string")
    docs = spark.createDataFrame([(1, "head " + " ".join(words[45:70]) + " tail"), (2, " ".join(words[:19])), (3, None)], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_removed) for r in remove_reference(spark, docs, ref, words=20).collect()}
    assert out == {1: ("head tail", 25), 2: (" ".join(words[:19]), 0), 3: (None, 0)}


def test_cut_keeps_other_white_space():
    assert cut(b"a  b\nc d", np.array([False, True, False, False])) == b"a  c d"
    assert cut(b" a b ", np.array([True, True])) == b""
