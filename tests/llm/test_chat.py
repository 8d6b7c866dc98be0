import sys

from pyspark.sql import functions as F

from netloom.llm import chat, queries

sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
from oracle import connect, same  # noqa: E402


def test_sql_queries(spark, sf):
    con = connect(sf)
    for name, sql in queries.oracle_sql().items():
        same(spark, con, queries.queries()[name], sql, sf)


def test_branches_and_ranks(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "more", 1.0), ("t", 9, 8, "user", "lost parent", None), ("u", 1, None, "user", "alone", None), (None, 1, None, "user", "null tree", 1.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.read_back(chat.format_chats(spark, m))
    got = {(r.tree, r["rank"]): [t.text for t in r.turns] for r in out.collect()}
    assert got == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "bad"], ("t", 3): ["lost parent"], ("u", 1): ["alone"], (None, 1): ["null tree"]}
    best = chat.format_chats(spark, m, keep=1)
    assert best.where("tree = 't'").count() == 1 and chat.format_chats(spark, m.limit(0)).count() == 0


def test_long_path_in_few_joins(spark):
    m = spark.range(1, 301).selectExpr("1L tree", "id node", "if(id > 1, id - 1, null) parent", "if(id % 2 = 0, 'assistant', 'user') role", "concat('x', id) text", "0.0D score")
    r = chat.read_back(chat.format_chats(spark, m)).first()
    assert [t.text for t in r.turns] == [f"x{i}" for i in range(1, 301)] and r.loss == [f"x{i}" for i in range(2, 301, 2)]


def test_cycles_end_at_once(spark):
    """A leaf below a cycle, a cycle alone and a node that answers itself have no branch; the rest of the tree has."""
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, None), (1, 5, 4), (2, 1, 1), (3, 7, 9), (3, 8, 7), (3, 9, 8), *((4, i, i - 1 or None) for i in range(1, 41)), *((4, i, 60 if i == 50 else i - 1) for i in range(50, 71))]
    m = spark.createDataFrame(rows, "tree long, node long, parent long").selectExpr("*", "'user' role", "concat('n', node) text", "1.0D score")
    out = {(r.tree, r.leaf): [t.text for t in r.turns] for r in chat.read_back(chat.format_chats(spark, m)).collect()}
    assert out == {(1, 5): ["n4", "n5"], (4, 40): [f"n{i}" for i in range(1, 41)]}


def test_very_long_texts_and_clashing_columns(spark):
    long = "<[&x" * 300_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string").selectExpr("*", "7 head", "8 start", "9 rank", "1 up")
    r = chat.read_back(chat.format_chats(spark, chat.turns_as_tree(df))).first()
    assert r.loss == [long] and r.turns[1].text == long


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "&lt;s>&amp;&#91;", "<s>", "", None, "a\nbé\U0001f600", "[/INST]</s>", "&", "<<SYS>>"]
    rows = [(i // 3, i, "assistant" if i % 2 else "</s>", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 tree", "2 node", "3 leaf", "4 score")
    out = chat.read_back(chat.format_chats(spark, chat.turns_as_tree(df)))
    back = sorted((r.tree, t.role, t.text or "") for r in out.collect() for t in r.turns)
    assert back == sorted((c, role, t or "") for c, _, role, t in rows)
    for r in out.collect():
        assert r.loss == [t.text for t in r.turns if t.role == "assistant"]


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "first"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree: [t.text for t in r.turns] for r in chat.read_back(chat.format_chats(spark, chat.turns_as_tree(df))).collect()}
    assert out == {1: ["first", "a", "a", "b"], None: ["x"]}


def test_native_plan(spark, sf):
    plan = queries.op10_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert queries.op10_chat_format(spark, sf).where(F.col("conv_id") == -1).first().n_turns == 2
