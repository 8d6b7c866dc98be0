"""Chat formatting from reply trees, with DataFrame functions only.

A message has a parent; a branch is a path from a root to a leaf. Iterative self-joins with doubled jumps list
all (leaf, ancestor) pairs in as many joins as the logarithm of the depth. Branches are ranked by score inside
their tree. Each branch becomes one text: <s>[INST]role[/INST]text</s> for each turn. Inside role and text the
characters & < [ are written &amp; &lt; &#91;, so that no text can hold a control string, and the change can be
undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.store import drop, table

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> messages (tree, node, parent, role, text, score): each turn answers the one before.

    Turns are numbered anew by (turn, role, text), nulls first, so that repeated and missing turn numbers have a
    defined order. Null role and text are empty. All rows of a null conv_id are one conversation. A conversation becomes
    one text, so its rows meet in one task and have to fit in a string of the JVM (2 GB).
    """
    own = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(spark: SparkSession, messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, node, parent, score) -> (tree, leaf, node, depth, rank): the nodes of each root-to-leaf path.

    depth counts from the root, 0. A branch's score is the mean of its nodes', null scores count 0; rank 1 is the
    best, ties go to the smaller leaf. keep leaves only so many branches of a tree. A node whose parent is not in
    its tree is a root. Nodes on a cycle and below one reach no root; such leaves are left out. Jumps are doubled
    once, one row a node; a jump that goes on after as many steps as the largest tree has nodes never ends.
    """
    own = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = own.select(F.col("tree").alias("known_tree"), F.col("node").alias("known_node"))
    nodes = own.join(known, F.expr("tree <=> known_tree and parent = known_node"), "left")
    nodes = table(spark, nodes.select("tree", "node", F.col("known_node").alias("parent"), "score"), "nodes")
    inner = nodes.where("parent is not null").select(F.col("tree").alias("pt"), F.col("parent").alias("pn")).distinct()
    leaves = nodes.join(inner, F.expr("tree <=> pt and node = pn"), "left_anti").select("tree", "node")
    jump = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("to"))
    jumps: list[DataFrame] = []
    largest: int | None = None
    while not jump.isEmpty():
        if len(jumps) == 4:  # a deep tree, or a cycle
            largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
        if largest is not None and 1 << len(jumps) > largest:
            endless = jump.select(F.col("tree").alias("et"), F.col("node").alias("en"))
            leaves = leaves.join(endless, F.expr("tree <=> et and node = en"), "left_anti")
            break
        jumps.append(jump)
        k = jump.select(F.col("tree").alias("kt"), F.col("node").alias("kn"), F.col("to").alias("far"))
        jump = table(spark, jump.join(k, F.expr("tree <=> kt and to = kn")).select("tree", "node", F.col("far").alias("to")), "jump")
    pairs = table(spark, leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "pairs0")
    for level, jump in enumerate(jumps):
        j = jump.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "to")
        more = pairs.join(j, F.expr("tree <=> jt and node = jn")).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << level)).alias("up"))
        longer = table(spark, pairs.unionByName(more), "pairs")
        drop(pairs)
        pairs = longer
    drop(*jumps[1:])
    scored = pairs.join(nodes.select(F.col("tree").alias("nt"), F.col("node").alias("nn"), "score", F.col("parent").isNull().alias("root")), F.expr("tree <=> nt and node = nn"))
    summed = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max("up").alias("top"), F.max("root").alias("whole")).where("whole")
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    r = table(spark, ranked.select(F.col("tree").alias("rt"), F.col("leaf").alias("rl"), "top", "rank"), "ranked")
    out = pairs.join(r, F.expr("tree <=> rt and leaf = rl"))
    return out.select("tree", "leaf", "node", (F.col("top") - F.col("up")).alias("depth"), "rank")


def format_chats(spark: SparkSession, messages: DataFrame, keep: int | None = None) -> DataFrame:
    """messages -> (tree, leaf, rank, formatted, spans): one row for each branch.

    spans lists (start, length) in characters of formatted, from 0, of the escaped assistant texts: the loss mask.
    Rows that repeat a (tree, node) count once: the least. Leaves that reach no root because of a cycle have no row.
    Texts are whole, however long. An empty table gives no rows; further columns are ignored.
    """
    rest = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    messages = table(spark, messages.groupBy("tree", "node").agg(rest).select("tree", "node", "m.*"), "messages")
    path = branches(spark, messages, keep)
    m = messages.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turns = path.join(m, F.expr("tree <=> mt and node = mn")).select("tree", "leaf", "rank", "depth", "role", "text")
    head = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE))
    turns = turns.withColumn("head", F.length(head)).withColumn("turn", F.concat(head, "text", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)))
    turns = turns.withColumn("span", F.when(F.col("role") == "assistant", F.struct((F.col("start") + F.col("head")).cast("int").alias("start"), F.length("text").alias("length"))))
    rows = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("rows"))
    return rows.select(
        "tree", "leaf", "rank",
        F.array_join(F.col("rows.turn"), "").alias("formatted"),
        F.filter("rows.span", lambda x: x.isNotNull()).alias("spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role and text, unescaped) and loss (array of the texts under the mask, unescaped)."""
    parts = F.filter(F.split(F.col("formatted"), CLOSE), lambda x: x != "")
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.substring_index(x, MIDDLE, 1), OPEN, -1)).alias("role"),
        unescape(F.substring_index(x, MIDDLE, -1)).alias("text"),
    ))
    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", turns).withColumn("loss", loss)
