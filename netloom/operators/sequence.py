"""Order-dependent operators: runs, keep-first policies, chains, journals, as-of values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ordered import group_row_numbers, prefix_sum
from netloom.session import cut_lineage

#: bits of a block of `scan_chains_of_bits`
SPAN = 1 << 16


def longest_run(slots: DataFrame, group: str, pos: str, free: Column) -> DataFrame:
    """(group, longest): length of the longest run of free neighbouring slots; 0 where none is free."""
    w = Window.partitionBy(group).orderBy(pos)
    own = slots.select(group, pos, free.alias("free"))
    run = own.where("free").select(group, (F.col(pos) - F.row_number().over(w)).alias("k")).groupBy(group, "k").count()
    best = run.groupBy(group).agg(F.max("count").alias("longest"))
    return own.select(group).distinct().join(best, group, "left").select(group, F.coalesce("longest", F.lit(0)).alias("longest"))


def keep_edge(metrics: DataFrame, pattern: str, first: bool = True) -> DataFrame:
    """metrics (pos, key, value): of the rows whose key fits the pattern only the first (or last) stays.

    The policy is per pattern, not per key; rows that don't fit all stay.
    """
    fits = F.col("key").rlike(pattern)
    edge = metrics.where(fits).agg((F.min if first else F.max)("pos").alias("edge"))
    return metrics.crossJoin(F.broadcast(edge)).where(~fits | (F.col("pos") == F.col("edge"))).drop("edge")


def scan_chains(cells: DataFrame, most: int) -> DataFrame:
    """cells (domain, falling, cell), one bit each -> (cell, domain, chain, place).

    Chains of at most `most` cells are filled per domain, falling edges first, then by cell.
    """
    own = group_row_numbers(cells.select("domain", "cell", (~F.col("falling")).alias("rising")), "domain", "rising", "cell")
    rn = F.col("rn")
    return own.select("cell", "domain", ((rn - 1) / most).cast("bigint").alias("chain"), ((rn - 1) % most).cast("bigint").alias("place"))


def scan_chains_of_bits(cells: DataFrame, most: int) -> DataFrame:
    """cells (domain, falling, cell, bits) -> (cell, domain, chain, first_bit): chains of at most `most` bits, filled per domain
    with falling edges first, then by cell; a cell that doesn't fit starts the next chain.

    The cells of a domain are cut by their first bits into blocks of about SPAN bits, a task's group each. A first pass finds for each
    block what every fill of the chain before it (0 to most bits) comes to behind it; these few rows, one a block, are followed from the
    domain's first block on, and a second pass fills the chains of each block from there. So a domain of most cells needs no task of its
    own, and there are two passes at any size. Cells of more than `most` bits, or of none, are refused.
    """
    if not cells.where((F.col("bits") > most) | (F.col("bits") < 1)).isEmpty():
        raise ValueError(f"cells must have 1 to {most} bits")
    own = prefix_sum(cells.select("domain", (~F.col("falling")).alias("rising"), "cell", F.col("bits").cast("long").alias("bits")), "domain", "bits", "rising", "cell")
    own = cut_lineage(own.select("domain", "cell", "bits", "total"))
    base = own.groupBy("domain").agg(F.min(F.col("total") - F.col("bits")).alias("base"))
    # at: bits before the cell in its domain
    own = own.join(base.withColumnRenamed("domain", "d"), F.col("domain").eqNullSafe(F.col("d"))).select("base", "domain", "cell", "bits", (F.col("total") - F.col("bits") - F.col("base")).alias("at"))
    own = cut_lineage(own.withColumn("block", F.expr(f"at div {max(SPAN, most)}")))
    rows = own.select("base", "block", "at", "bits")

    def behind(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        _, first, end = _starts(pdf, most)
        # from each start to behind the block: the fill of its last chain, and how many chains start
        fill, more, n = [0] * len(pdf), [0] * len(pdf), len(pdf)
        upto = (pdf["at"] + pdf["bits"]).tolist()
        at = pdf["at"].tolist()
        for i in range(n - 1, -1, -1):
            fill[i], more[i] = (upto[-1] - at[i], 1) if end[i] == n else (fill[end[i]], more[end[i]] + 1)
        whole = upto[-1] - at[0]
        found = [(f + whole, 0) if i == n else (fill[i], more[i]) for f, i in enumerate(first)]
        return pd.DataFrame({"base": [pdf["base"].iloc[0]], "block": [pdf["block"].iloc[0]], "fills": [[x for x, _ in found]], "chains": [[x for _, x in found]]})

    maps = rows.groupBy("base", "block").applyInPandas(behind, "base long, block long, fills array<long>, chains array<long>")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, fill, chain, out = pdf.sort_values("block"), 0, 0, []
        for base, block, fills, chains in zip(pdf["base"], pdf["block"], pdf["fills"], pdf["chains"], strict=True):
            out.append((base, block, fill, chain))
            fill, chain = int(fills[fill]), chain + int(chains[fill])
        return pd.DataFrame(out, columns=["base", "block", "fill", "chain"])

    entry = cut_lineage(cut_lineage(maps).groupBy("base").applyInPandas(follow, "base long, block long, fill long, chain long"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        fill, chain = int(pdf["fill"].iloc[0]), int(pdf["chain"].iloc[0])
        at, first, end = _starts(pdf, most)
        heads, i = [], int(first[fill])
        while i < len(pdf):
            heads.append(i)
            i = end[i]
        new = np.searchsorted(heads, np.arange(len(pdf)), "right")  # chains that have started
        start = np.concatenate([[at[0] - fill], at[heads]]) if heads else np.array([at[0] - fill])
        return pd.DataFrame({"base": pdf["base"], "at": at, "chain": chain + new, "first_bit": at - start[new]})

    numbered = rows.join(entry, ["base", "block"]).groupBy("base", "block").applyInPandas(number, "base long, at long, chain long, first_bit long")
    return own.join(numbered, ["base", "at"]).select("cell", "domain", "chain", "first_bit")


def _starts(pdf: pd.DataFrame, most: int) -> tuple[np.ndarray, list[int], list[int]]:
    """A block's cells (at, bits) in their order -> (at, the first cell that starts a chain for each fill from 0 to most before the
    block, for each cell the one that starts the next chain if it starts one); the number of cells stands for none."""
    at, upto = pdf["at"].to_numpy(), (pdf["at"] + pdf["bits"]).to_numpy()
    first = np.searchsorted(upto, at[0] - np.arange(most + 1) + most, "right")
    return at, first.tolist(), np.searchsorted(upto, at + most, "right").tolist()


def replay(journal: DataFrame) -> DataFrame:
    """journal (seq, op, obj, field, value) -> (obj, field, value): last set value of objects not deleted after it."""
    gone = journal.where("op = 'delete'").groupBy("obj").agg(F.max("seq").alias("gone"))
    sets = journal.where("op = 'set'").join(gone, "obj", "left").where("gone is null or seq > gone")
    return sets.groupBy("obj", "field").agg(F.max_by("value", "seq").alias("value"))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left (id, by, at) with the last value of right (by, at, value) at or before `at`.

    One union and one window by key instead of a range join. Of equal times the largest value counts.
    """
    r = right.groupBy(by, at).agg(F.max(value).alias("_v")).select(by, at, F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("id"), "_v")
    both = r.unionByName(left.select(by, at, F.lit(1).alias("_side"), "id", F.lit(None).cast(r.schema["_v"].dataType).alias("_v")))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", True).over(w)).where("_side = 1").select("id", F.col("_last").alias(value))


def changes(waves: DataFrame) -> DataFrame:
    """waves (id, t, value) -> rows at which the value differs from the one before, the first included."""
    w = Window.partitionBy("id").orderBy("t", "value")
    return waves.withColumn("_before", F.lag("value").over(w)).where("`_before` is null or not (`_before` <=> value)").drop("_before")


def remove_member(groups: DataFrame, member: DataFrame) -> DataFrame:
    """groups (g, member) without the given members; groups left empty disappear with their last row."""
    return groups.join(member, "member", "left_anti").groupBy("g").agg(F.sort_array(F.collect_list("member")).alias("members"))


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(column, id): each distinct value and its number from 1 in the order of the values."""
    from netloom.operators.ordered import row_numbers

    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return row_numbers(distinct, column, name="id")
