"""Global order without a single-task window: running sums and row numbers over ranges of the order.

Rows are ordered by key, ties and a hash of the whole row. Quantiles of a sample of these cut them into parts of
about ROWS rows, so a key with few values is cut as well: only rows that are equal in all columns always stay together. A
window runs inside each part, and the parts' totals (one row a part) are summed up and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

ROWS = 1 << 20
#: parts are larger than ROWS where there were more than so many
MOST_PARTS = 4096
#: sampled rows for each part
SAMPLED = 40
#: more bounds than this are looked up in two steps
NESTED = 64


def _part(place: Column, bounds: list[Column], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(place < bounds[mid], _part(place, bounds, lo, mid)).otherwise(_part(place, bounds, mid + 1, hi))


def _part_of_many(place: Column, bounds: list[Column]) -> Column:
    """How many bounds are at most the place: first the piece of the bounds, then the place in it, so that a row is
    compared with about twice the root of their number."""
    step = int(len(bounds) ** 0.5) + 1
    pieces = F.array(*[F.array(*bounds[i : i + step]) for i in range(0, len(bounds), step)])
    before = F.greatest(F.size(F.filter(pieces, lambda p: p[0] <= place)) - 1, F.lit(0))
    return before * step + F.size(F.filter(F.get(pieces, before), lambda b: b <= place))


def _literal(x, kind: DataType) -> Column:
    """A collected value as a column, structs field by field."""
    if isinstance(kind, StructType) and x is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(x, kind.fields, strict=True)])
    return F.lit(x).cast(kind)


def _comparable(x):
    """A collected value as a sort key in which nulls come first, also inside of structs."""
    return (False, 0) if x is None else (True, tuple(map(_comparable, x)) if isinstance(x, tuple) else x)


def ranged(df: DataFrame, key: str, *ties: str, rows: int = ROWS) -> DataFrame:
    """Adds `part`: what comes later in the order is in the same part or a later one; nulls come first."""
    names = [key, *ties]
    place = F.struct(*[F.col(c) for c in names], F.xxhash64(*df.columns))
    n = df.count()
    cuts = min(n // rows, MOST_PARTS - 1)
    if not cuts:
        return df.withColumn("part", F.lit(0))
    share = min(1.0, 2.0 * SAMPLED * cuts / n)
    held = sorted((r.place for r in df.select(place.alias("place")).sample(share, 7).collect()), key=lambda p: [_comparable(x) for x in p])
    step = len(held) / (cuts + 1)
    picked = list(dict.fromkeys(tuple(held[int((i + 1) * step)]) for i in range(cuts) if int((i + 1) * step) < len(held)))
    kinds = [df.schema[c].dataType for c in names]
    bounds = [F.struct(*[_literal(x, t) for x, t in zip(p, kinds, strict=False)], F.lit(p[-1]).cast("long")) for p in picked]
    return df.withColumn("part", _part(place, bounds, 0, len(bounds)) if len(bounds) <= NESTED else _part_of_many(place, bounds))


def prefix_sum(df: DataFrame, key: str, value: str, *ties: str, rows: int = ROWS) -> DataFrame:
    """Adds `total`: the sum of value over all rows up to this one in the order of key and ties."""
    own = ranged(df, key, *ties, rows=rows)
    sums = own.groupBy("part").agg(F.sum(value).alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))  # a row for each part
    local = F.sum(value).over(Window.partitionBy("part").orderBy(key, *ties, F.xxhash64(*df.columns)).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("local", local).join(F.broadcast(before), "part").withColumn("total", F.col("before") + F.col("local")).drop("part", "local", "before")


def row_numbers(df: DataFrame, key: str, *ties: str, rows: int = ROWS, name: str = "rn") -> DataFrame:
    """Adds consecutive numbers from 1 in the order of key and ties."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return prefix_sum(one, key, "_one", *ties, rows=rows).withColumnRenamed("total", name).drop("_one")


def group_row_numbers(df: DataFrame, group: str, *keys: str, rows: int = ROWS, name: str = "rn") -> DataFrame:
    """Adds numbers from 1 inside each group in the order of the keys; a group of most rows is many parts."""
    own = row_numbers(df, group, *keys, rows=rows, name="_all")
    first = own.groupBy(group).agg((F.min("_all") - 1).alias("_before")).withColumnRenamed(group, "_group")
    numbered = own.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return numbered.withColumn(name, F.col("_all") - F.col("_before")).drop("_all", "_before", "_group")
