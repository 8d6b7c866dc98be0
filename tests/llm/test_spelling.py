import collections
import random
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import queries, spelling
from netloom.llm.textops import Words, chunks

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(x):
    return re.sub("[A-Z]", lambda c: c[0].lower(), x)


def brute_count(rows):
    n = collections.Counter()
    for i, text in rows:
        for x in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            n[x if h % 199 else x[: h % len(x)] + x[h % len(x) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def brute_groups(n):
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out)


def corpus():
    r = random.Random(5)
    base = ["thanedble", "ciónción", "straße", "ÀÉÎabc", "aaaaaa", "aaaaaaa", "÷×÷×÷×", "onetwo", "zzzzzzz", "belich"]
    words = [lower(b) for b in base]
    for b in base * 12:
        k = r.randrange(len(b))
        words.append(lower(r.choice([b[:k] + b[k + 1 :], b[:k] + r.choice("abcé") + b[k:], b[:k] + r.choice("xyÿ") + b[k + 1 :]])))
    rows = []
    for i in range(150):
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in r.choices(words, [3000 / (j + 1) ** 2 + 1 for j in range(len(words))], k=60)) + r.choice([".", "1", "漢", "ā", "Ã"])))
    return [*rows, (None, "thanedble " * 7), (None, None), (3, ""), (3, rows[3][1]), (3, rows[3][1]), (900, "q" * 5000), (901, "onetwoÃ" * 9), (902, "abcdefg " * 6), (903, "chainaa " * 6 + "chainab " * 40), (904, "chainbb " * 250)]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr("*", "'x' word", "1 n", "2 root").repartition(4)
    words = spelling.count_words(spark, df)
    want = brute_count(corpus())
    assert {r.word: r.n for r in words.collect()} == want
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(spark, words).collect()), key=lambda r: r[0])
    assert got == brute_groups(want)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # some chain is longer than one


def test_held_words_are_passed_on(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in corpus()], pa.int64()), pa.array([t for _, t in corpus()], pa.string())], ["doc_id", "text"])
    monkeypatch.setattr(spelling, "HELD", 4)
    n = collections.Counter()
    for out in spelling._counter(199)(iter([batch.slice(k, 10) for k in range(0, len(batch), 10)])):
        for w, k in zip(*(c.to_pylist() for c in out.columns), strict=True):
            n[w] += k
    assert {w: k for w, k in n.items() if len(w) >= 6 and k >= 5} == brute_count(corpus())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, sf).collect()), key=lambda r: r[0])
    assert len(got) > 500 and got == brute_groups(brute_count(rows))


def test_empty(spark):
    assert spelling.group_variants(spark, spelling.count_words(spark, spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=1, max_size=8), st.integers(0, 8), st.sampled_from("abcéÿ"), st.integers(0, 2))
def test_one_edit_leaves_a_band_alone(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = (word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at + 1 :])[kind]
    a, b = spelling.masks([word, other or "a"])
    assert not other or (a == b).any() and sum(int(x).bit_count() for x in a ^ b) <= 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aZÃé÷1 āb", max_size=60), max_size=5))
def test_checksums(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for row, end, offsets, data in chunks(batch):
        w = Words(offsets, data, lower=True, space=spelling.latin_runs(data))
        low = spelling.LOWER_BYTE[data]
        got = [low[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
        assert got == [lower(x) for t in texts[row:end] for x in RUN.findall(t)]
        crc = spelling.run_checksums([f"{i}:".encode() for i in range(row, end)], w, low)
        assert crc.tolist() == [zlib.crc32(f"{row + d}:{x}".encode()) for d, x in zip(w.doc, got, strict=True)]
