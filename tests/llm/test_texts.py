"""Quality, language, BPE, fingerprints, decontamination: accuracy, round trips and brute force; edge rows of each."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netloom.llm import bpe, decontam, fingerprint, langid, quality, queries

EDGE = [(1, "one text, said twice"), (1, "one text, said twice"), (2, None), (3, ""), (4, " \n"), (5, "x" * 100_000), (None, "no id"), (6, "日本 é \U0001f600 \x00 end")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "'x' score", "1 ids", "'y' lang_pred", "2 part", "3 item_id", "4 start")


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    out = queries.op2_quality(spark, big).collect()
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (9, 1)], "doc_id long, label int")
    model = quality.train(spark, edge, labels)
    assert quality.score(spark, edge, model).count() == len(EDGE)
    assert quality.keep(spark, edge, model, 0.0).count() == len(EDGE) and quality.keep(spark, edge, model, 0.0).columns == edge.columns
    none = quality.train(spark, edge.limit(0), labels.limit(0))
    assert {r.score > 0.5 for r in quality.score(spark, edge, none).collect()} == {True}
    assert quality.score(spark, edge.limit(0), model).count() == 0


def test_dual_descent_separates():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 4]), np.array([3, 5])] * 5
    model = quality.fit(rows, np.array([1, 1, 0, 0] * 5))
    doc = np.repeat(np.arange(len(rows)), 2)
    assert ((model.scores(doc, np.concatenate(rows), len(rows)) >= 0.5) == np.array([1, 1, 0, 0] * 5)).all()


def test_quality_follows_its_definition():
    """Against the plain definition: indicators of n-grams with Counters, log-count ratios, and the dual's optimum."""
    import math
    import random

    import pyarrow as pa

    from netloom.llm.textops import chunks

    r = random.Random(4)
    good = [" ".join(r.choice("the of and is a to in it was for".split()) for _ in range(r.randint(4, 20))) + "." for _ in range(30)]
    junk = [" ".join(r.choice(["BUY", "now!!!", "$$$", "c1ick", "here", "the"]) for _ in range(r.randint(4, 20))) for _ in range(20)]
    texts, labels = good + junk, np.array([1] * len(good) + [0] * len(junk))
    (_, _, offsets, data), *_ = chunks(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    doc, feature = quality.features(offsets, data)
    rows = [feature[doc == d] for d in range(len(texts))]
    assert all(len(set(x.tolist())) == len(x) > 0 for x in rows)
    cost, epochs = 4.0, 400
    model = quality.fit(rows, labels, cost=cost, epochs=epochs)
    seen = [collections.Counter(), collections.Counter()]
    for x, y in zip(rows, labels, strict=True):
        seen[y].update(x.tolist())
    total = [quality.DIMENSIONS + sum(c.values()) for c in seen]
    for f in {int(f) for x in rows for f in x}:
        want = math.log((1 + seen[1][f]) / total[1]) - math.log((1 + seen[0][f]) / total[0]) - (math.log(1 / total[1]) - math.log(1 / total[0]))
        assert abs(model.ratio[f] - want) < 1e-9
    # weak duality: the primal objective of the weights is as low as the dual's value, so both are optimal
    unit = [(v := model.ratio[x]) / np.sqrt(v @ v) for x in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    margin = np.array([model.weight[x] @ v + model.bias for x, v in zip(rows, unit, strict=True)]) * sign
    weigh = np.where(labels == 1, cost * len(labels) / (2 * labels.sum()), cost * len(labels) / (2 * (1 - labels).sum()))
    primal = (model.weight @ model.weight + model.bias**2) / 2 + (weigh * np.maximum(0, 1 - margin)).sum()
    matrix = np.zeros((len(rows), len(rows)))
    for i, (x, v) in enumerate(zip(rows, unit, strict=True)):
        for j, (y, u) in enumerate(zip(rows, unit, strict=True)):
            mine = dict(zip(x.tolist(), v, strict=True))
            matrix[i, j] = sign[i] * sign[j] * (1 + sum(mine.get(f, 0.0) * g for f, g in zip(y.tolist(), u, strict=True)))
    alpha = np.zeros(len(rows))
    for _ in range(4000):  # plain projected steps on the dual
        alpha = np.clip(alpha - (matrix @ alpha - 1) / np.trace(matrix), 0, weigh)
    dual = alpha.sum() - alpha @ matrix @ alpha / 2
    assert dual <= primal + 1e-6 and primal - dual < 0.02 * max(1.0, primal)


def test_language_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op5_language(spark, big).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edges(spark, edge):
    learn = edge.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 6, "ja"))
    profiles = langid.train(learn)
    assert set(profiles) == {"en", "ja"}
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark, edge, profiles).collect()}
    assert out[2] == out[3] == out[4] == ("und", 0.0) and out[1][0] == "en" and out[6][0] == "ja" and out[1][1] > 0.99
    assert {r.lang_pred for r in langid.identify(spark, edge, langid.train(learn.limit(0))).collect()} == {"und"}


def test_out_of_place_distance_by_hand():
    import pyarrow as pa

    text = "ab abc b"
    padded = " " + text + " "
    grams = collections.Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if " " not in padded[i : i + n][1 : n - 1] and padded[i : i + n].strip())
    _, g, c = langid.gram_counts(pa.array([text]))
    back = lambda x: "".join(" " if p == 1 else chr(p) for p in (int(x) >> 42, int(x) >> 21 & 0x1FFFFF, int(x) & 0x1FFFFF) if p)
    assert {back(x): int(n) for x, n in zip(g, c, strict=True)} == grams
    p = langid.Profiles({"x": g[:2], "y": g[2:4]}, size=300)
    lang, score = p.predict(pa.array([text]))
    rank = {int(x): r for r, x in enumerate(sorted(g.tolist(), key=lambda x: (-grams[back(x)], x)))}
    far = {name: sum(abs(rank[int(x)] - list(prof).index(x)) if x in prof else 300 for x in g) for name, prof in (("x", list(g[:2])), ("y", list(g[2:4])))}
    assert lang == [min(far, key=lambda n: (far[n], n))] and abs(score[0] - (1 - min(far.values()) / (len(g) * 300))) < 1e-12


@pytest.fixture(scope="module")
def codec():
    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ours = bpe.Codec(bpe.model_bytes(tokens), tokens, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return ours, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken(codec, text):
    ours, theirs = codec
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text) and ours.decode(ids) == text.encode()


def test_bpe_query(spark, edge, codec):
    out = bpe.tokenize(spark, edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(out) == len(EDGE)
    for r, (doc_id, text) in zip(out, EDGE, strict=True):
        ids = codec[1].encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (doc_id, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def weighted_jaccard(a, b):
    x, y = collections.Counter(a.encode().split()), collections.Counter(b.encode().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints_follow_their_definition(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    out = {r.doc_id: r for r in fingerprint.compare_edits(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(out) == len(rows)
    errors = []
    for (i, t), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        n = len(t) // 2
        edited = t[: len(t) - n] + following[:n]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [out[i].near_edited - weighted_jaccard(t, edited), out[i].near_next - weighted_jaccard(t, following)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all(prints[i] == out[i].fingerprint for i in out)


def test_fingerprint_ranges_and_edges(spark, edge):
    rows = [(i * 2, f"doc {i} " * (i % 5 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    whole = sorted(map(tuple, fingerprint.compare_edits(spark, df, parts=1).collect()))
    for parts in (7, 80):  # more ranges than rows leaves some empty
        assert sorted(map(tuple, fingerprint.compare_edits(spark, df, parts=parts).collect())) == whole
    edited = {r[0]: r[2] for r in whole}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 2
        assert edited[i] == hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()
    # a third and more of the rows have one id, or none: their ranges are cut too
    same = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) doc_id", "concat('text ', if(id % 3 = 0, 1, id)) text")
    sizes = [r["count"] for r in fingerprint.in_order(same, 30).groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300
    assert fingerprint.compare_edits(spark, same, parts=30).count() == 3000
    assert fingerprint.compare_edits(spark, edge).count() == len(EDGE)
    assert fingerprint.compare_edits(spark, edge.limit(0)).count() == 0
    one = fingerprint.compare_edits(spark, spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"a b a b"[:0] + b"a b " + b"a b").hexdigest())]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination_finds_edited_items(spark):
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(10, 40)))) for i in range(30)] + [(77, "tiny"), (78, None), (79, "")]
    docs, planted = [], set()
    for d in range(120):
        text = " ".join(word() for _ in range(200))
        if d % 3 == 0:
            i, item = items[d % 30]
            chars, k = list(item), int(decontam.RATE * len(decontam.normalise(item))) if d % 2 else 0
            for _ in range(k):
                at = r.randrange(len(chars))
                chars[at : at + 1] = r.choice([["q"], [], [chars[at], "q"]])
            text = text[:500] + " É\n" + "".join(chars).upper() + "\t" + text[500:]
            planted.add((d, i))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "a tiny one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", F.lit("x"))
    out = decontam.contaminated(spark, df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in out} == planted | {(502, 77)}
    texts, want = dict(docs), dict(items)
    for x in out:
        piece, item = decontam.normalise(texts[x.doc_id][x.start : x.end]), decontam.normalise(want[x.item_id])
        assert levenshtein(piece, item) == x.edits <= decontam.RATE * len(item)


def least_edits(item, text):
    """Sellers: the least edits of the whole item against any piece of the text, for every end of the piece."""
    row = np.arange(len(item) + 1)
    out = [int(row[-1])]
    for x in text:
        new = np.empty_like(row)
        new[0] = 0
        for i, y in enumerate(item, 1):
            new[i] = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != y))
        row = new
        out.append(int(row[-1]))
    return out


@pytest.mark.parametrize("postings", [decontam.MAX_POSTINGS, 300])
def test_decontamination_equals_brute_force(monkeypatch, postings):
    """All pairs of documents and items, many of them with one common opening, and repetitive texts."""
    import random

    import pyarrow as pa

    from netloom.llm.textops import chunks

    monkeypatch.setattr(decontam, "MAX_POSTINGS", postings)
    r = random.Random(9)
    word = lambda n=7: "".join(r.choice("etao ") for _ in range(r.randint(2, n)))
    stem = "which of the following answers is right: "
    items = [(i, stem + word(30) + word(30)) for i in range(12)] + [(20 + i, word(60) + word(60)) for i in range(6)] + [(40, "la " * 12), (41, "short")]
    texts = []
    for d in range(40):
        chars = list(stem * (d % 3) + word(80) + r.choice(items)[1] + word(80))
        for _ in range(r.randint(0, 14)):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice([["z"], [], [chars[at], "t"]])
        texts.append("".join(chars))
    texts += ["la " * 60, "x" + items[0][1] + " and again " + items[0][1] + "y", ""]
    (_, _, offsets, data), *rest = chunks(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    assert not rest
    found = decontam.find_items(decontam.Items(items), offsets, data)
    ours = decontam.Items(items)
    budget = dict(zip(ours.ids, ours.edits, strict=True))
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            raw = decontam.normalise(item)
            ends = least_edits(raw, decontam._squeeze(np.array([0, len(t.encode())]), np.frombuffer(t.encode(), np.uint8))[1].tobytes())
            if min(ends) <= budget.get(i, 0):
                want[d, i] = min(ends)
    got = {}
    for d, i, a, b, edits in found:
        got[d, i] = min(got.get((d, i), 99), edits)
        piece = data.tobytes()[a:b]
        assert levenshtein(decontam.normalise(piece.decode()), decontam.normalise(dict(items)[i])) <= edits + 1
    assert got == want and len(want) > 40
    assert sum((x[0], x[1]) == (41, 0) for x in found) == 2  # one row for each place
    for x, y in zip(found, found[1:], strict=False):
        assert x[:2] != y[:2] or y[2] >= x[3]
    assert len([x for x in found if x[:2] == (40, 40)]) >= 4


def test_decontamination_with_one_common_opening():
    """1000 items of one opening against texts that have it: the time of some milliseconds a text."""
    import time

    import pyarrow as pa

    from netloom.llm.textops import chunks

    r = np.random.default_rng(3)
    letters = np.frombuffer(b"etaoinshrdlu      ", np.uint8)
    piece = lambda n: r.choice(letters, n).tobytes().decode()
    stem = "Read the passage and choose the best of the four answers below: "
    items = decontam.Items([(i, stem + piece(50)) for i in range(1000)])
    (_, _, offsets, data), *_ = chunks(pa.RecordBatch.from_arrays([pa.array([piece(100) + stem + piece(100) for _ in range(20)])], ["text"]))
    start = time.perf_counter()
    assert decontam.find_items(items, offsets, data) == []
    assert time.perf_counter() - start < 30


def test_decontamination_in_parts_and_edges(spark, edge, monkeypatch):
    items = spark.createDataFrame([(i, f"this is the benchmark passage of number {i} with some words") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so this is the benchmark passage of number 3 with some words, he said")], "doc_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(spark, docs, items).collect()))
    monkeypatch.setattr(decontam, "MAX_ITEM_BYTES", 100)
    assert sorted(map(tuple, decontam.contaminated(spark, docs, items).collect())) == whole and (1, 3) in {x[:2] for x in whole}
    assert decontam.contaminated(spark, edge, items).count() == 0
    assert decontam.contaminated(spark, edge, items.limit(0)).count() == 0
    assert decontam.contaminated(spark, docs.limit(0), items).count() == 0
