import random

import pytest


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """The documents of the smallest scale with planted copies, passages, benchmark items and junk."""
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    rows = docs.orderBy("doc_id").limit(300).collect()
    items = spark.read.parquet(f"{big}/benchmark.parquet").orderBy("item_id").collect()
    labels = spark.read.parquet(f"{big}/labels.parquet")
    good = [r for r in rows if r.lang == "en" and 1500 < r.n_chars < 4000 and not any(c in r.text for c in "|$%#!")]
    r = random.Random(8)
    passage = " ".join(r.choice(good).text.split()[0] + str(i) for i in range(70))
    new = {}
    for k in range(4):
        words = [f"{w}x{k}" if i % 3 == 0 else w for i, w in enumerate(good[k].text.split())]
        new[90000 + k] = " ".join(words[:100]) + "\n" + passage + "\n" + " ".join(words[100:])
    near = good[5].text.split()
    near[10] = "changed"
    new[91000], new[91001] = good[5].text, " ".join(near)
    new[92000] = good[6].text[:900] + " " + items[0].text + " " + " ".join(f"{w}q" for w in good[6].text[900:].split())
    new[93000] = None
    folder = str(tmp_path_factory.mktemp("sf"))
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in new.items()], docs.schema)
    docs.where("doc_id < 300").unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{big}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, passage, labels


def test_stages(spark, planted):
    import corpus_pipeline as c
    from netloom.llm.store import table

    folder, passage, labels = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in c.STAGES[:-1]:
        docs = table(spark, stage(spark, docs, folder), name)
        assert docs.columns == names
        seen[name] = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and doc_id < 300").collect()}
    assert len(good - set(seen["quality"])) <= 0.03 * len(good)
    assert len({r.doc_id for r in labels.where("quality = 0 and doc_id < 300").collect()} & set(seen["quality"])) <= 3
    assert not {91000, 91001} & set(seen["near_dedup"]) and {90000, 90001, 92000} <= set(seen["near_dedup"])
    assert not any(passage in (r.text or "") for r in seen["substring_dedup"].values())
    assert all(len(r.text) == r.n_chars for r in seen["substring_dedup"].values())
    assert 92000 not in seen["decontaminate"] and 92000 in seen["substring_dedup"]
    out = c.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == set(seen["decontaminate"])


def test_empty_documents(spark, planted, tmp_path):
    import corpus_pipeline as c

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_in_every_stage(spark, planted, tmp_path):
    """Repeated rows, ids that are null or shared by different texts, extra columns, a very long text."""
    import corpus_pipeline as c
    from netloom.llm.store import table

    folder = planted[0]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    say = lambda k, n=60: " ".join(f"word{k}and{i}" for i in range(n))
    passage = say("p", 80)
    rows = [
        (1, say(1)), (1, say(1)), (1, say(2)), (None, say(3)), (None, say(4)), (None, say(3)), (2, say(4) + " more"), (3, None), (3, ""), (None, None),
        (4, say(5) + " " + item + " " + say(6)), (4, say(7)), (None, say(8) + " " + item), (5, say(9) + " " + passage + " " + say(10)), (None, say(11) + " " + passage + " " + say(12)),
        (6, say("long", 150_000)), (7, say(13)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keys string")
    docs = docs.selectExpr("*", "1 kept", "2 key", "3 id", "4 digest", "5 component_id", "6 th", "7 odd_id")
    docs = table(spark, docs, "odd")
    near = table(spark, c.drop_near_duplicates(spark, docs, folder), "near")
    kept = sorted((r.doc_id or -1, r.text or "") for r in near.collect())
    gone = [(1, say(1)), (None, say(3)), (None, say(4))]  # one of each pair of equal rows, and a copy of document 2
    want = sorted((i or -1, t or "") for i, t in rows)
    for i, t in gone:
        want.remove((i or -1, t))
    assert kept == want and near.columns == docs.columns
    cut = table(spark, c.cut_repeats(spark, near, folder), "cut")
    assert cut.columns == docs.columns and cut.count() == near.count()
    assert not any(passage in r.text for r in cut.collect()) and any(r.text.startswith(say(11)) and r.doc_id is None for r in cut.collect())
    clean = table(spark, c.drop_contaminated(spark, cut, folder), "clean")
    left = {(r.doc_id, r.text.split(" ")[0]) for r in clean.collect()}
    assert (4, "word7and0") in left and not {(4, "word5and0"), (None, "word8and0")} & left and clean.count() == cut.count() - 2
    assert c.encode(spark, clean, folder).count() == clean.count()
    model_rows = c.keep_quality(spark, docs, folder)
    assert model_rows.columns == docs.columns and model_rows.count() <= len(rows)


INNER = "_key key odd_id odd_digest own_row own_id own_digest row rest n_words n_removed kept_sha256 id th spans m s at n times periodic keys sketch digest size component_id kept label score features item_id".split()


@pytest.mark.parametrize("ids", ["single", "repeated"])
def test_no_name_of_a_column_matters(spark, planted, ids):
    """Further columns with the names that the stages use inside give the rows that are got without them."""
    import corpus_pipeline as c
    from netloom.llm.store import table

    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 or doc_id >= 90000")
    if ids == "repeated":
        docs = docs.selectExpr("if(doc_id < 8, doc_id div 2, if(doc_id = 9, null, doc_id)) doc_id", "text", "lang", "source", "n_chars")
    docs = table(spark, docs, "docs")
    names = docs.columns
    more = table(spark, docs.selectExpr("*", *[f"concat('{n}', doc_id) `{n}`" for n in INNER], "'d' `a.b``c`"), "more")
    for name, stage in c.STAGES[:-1]:
        plain, odd = table(spark, stage(spark, docs, folder), name), table(spark, stage(spark, more, folder), name)
        assert odd.columns == more.columns and plain.columns == names, name
        assert sorted(map(str, odd.select(names).collect())) == sorted(map(str, plain.collect())), name
        assert odd.where(" or ".join(f"not (`{n}` <=> concat('{n}', doc_id))" for n in INNER)).isEmpty(), name
        docs, more = plain, odd
    a, b = (sorted(map(str, c.encode(spark, d, folder).collect())) for d in (docs, more))
    assert a == b
