"""Ranked lexical search: compressed postings by shard, document-at-a-time heap merge, bounded result heaps.

Index: each task cuts the texts that it reads into shards of at most SHARD_BYTES and SHARD_DOCS (texts aren't shuffled).
Inside a shard documents are numbered in the order of doc_id; a term's postings are pairs (step to the next document,
occurrences) as variable-length bytes. The index is a table of a row for each shard and term, with one more row for
each shard that holds its doc_ids and lengths, so it is built once and searched often, and a search reads the rows of
its own terms only.

Search: the lists of a shard's query terms meet in one task, for a block of items at a time. For each item its lists
are merged by a heap in the order of documents. A list's bound is its largest addend; lists whose bounds together
can't reach the tenth best score any more leave the heap and are only looked up, for documents that can still win
(exact: no document is lost). A heap of k results, keyed by score and then doc_id, gives the shard's best; the best of
all shards are ranked at last, where Spark keeps k rows an item in each task before it shuffles them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.store import drop, small_batches, table
from netloom.llm.textops import Words, chunks, take_strings

SHARD_BYTES = 8 << 20
SHARD_DOCS = 200_000
BLOCK_ITEMS = 1000
BROADCAST_BYTES = 16 << 20
#: a term's least addend is 0; saturation and length shares of the score in hundredths
LENGTH_SHARE = 75
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The terms of a text in order; null for a null text."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({TERM})"), F.lit(1))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, seven bits each with a mark on all but the last; and each value's first byte place."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        has = size > j
        out[at[:-1][has] + j] = (values[has] >> 7 * j & 127) | np.where(size[has] > j + 1, 128, 0)
    return out, at


def decode(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    if not len(data):
        return data
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127) << 7 * place, first)


class _Shard:
    """Documents of one shard in the making: for each chunk its distinct (document, term) pairs with counts."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.data: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, ids: list[int | None], offsets: np.ndarray, data: np.ndarray) -> None:
        w = Words(offsets, data, lower=True, space=_GAP[data])
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)])
        count = np.diff(np.concatenate([first, [len(h)]]))
        at = order[first]
        self.pairs.append((h[first], d[first] + len(self.ids), count, w.start[at] + self.bytes, w.end[at] + self.bytes))
        self.ids += ids
        self.lengths.append(w.count)
        self.data.append(data)
        self.bytes += len(data)

    def rows(self, shard: int) -> pa.RecordBatch:
        h, d, count, start, end = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        length, data = np.concatenate(self.lengths).astype(np.int64), np.concatenate(self.data)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, known))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        d = place[d]
        by = np.lexsort((d, h))
        h, d, count = h[by], d[by], count[by]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        df = np.diff(np.concatenate([first, [len(h)]]))
        step = np.diff(d, prepend=0)
        step[first] = d[first]
        both = np.empty(2 * len(d), np.int64)
        both[0::2], both[1::2] = step, count
        raw, at = encode(both)
        names = take_strings(data, start[by[first]], end[by[first]])
        cuts = np.concatenate([at[2 * first], [len(raw)]]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
        table_ = pa.array([np.stack([ids, known, length])[:, order].tobytes()], pa.binary())
        n = len(first) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)), pa.concat_arrays([pa.array([None], pa.string()), names]), pa.array(np.concatenate([[np.count_nonzero(length)], df]).astype(np.int64)),
                pa.array(np.concatenate([[length.sum()], np.zeros(n - 1)]).astype(np.int64)), pa.concat_arrays([table_, lists]),
            ],
            ["shard", "term", "df", "total", "postings"],
        )


def build(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the index (shard, term, df, total, postings), written as a table.

    A row without a term holds a shard's documents: df those with a term, total all their terms. Terms are told apart
    inside a shard by a 64-bit hash, between shards by themselves. Null and empty texts are documents without terms.
    Each row is a document, also if rows share a doc_id or have none. A text is in one shard however long it is.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, end, offsets, data in chunks(batch):
                if shard.ids and (shard.bytes + len(data) > SHARD_BYTES or len(shard.ids) >= SHARD_DOCS):
                    yield shard.rows(number)
                    number, shard = number + 1, _Shard()
                shard.add(ids[row:end], offsets, data)
        if shard.ids:
            yield shard.rows(number)

    index = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "shard long, term string, df long, total long, postings binary")
    return table(spark, index, "index")


@dataclass
class _List:
    """A term's postings in a shard: documents, addends and the largest of these."""

    docs: list[int]
    addends: list[int]
    bound: int

    def times(self, n: int) -> _List:
        return self if n == 1 else _List(self.docs, [n * x for x in self.addends], n * self.bound)


def best(lists: list[_List], k: int) -> list[tuple[int, int]]:
    """The k documents of the highest sums of addends, (sum, document) from the best on; of equal sums the first documents."""
    lists = sorted(lists, key=lambda x: x.bound)
    n = len(lists)
    docs, addends = [x.docs for x in lists], [x.addends for x in lists]
    size = [len(x) for x in docs]
    upto = [0]  # bounds of the first i lists together
    for x in lists:
        upto.append(upto[-1] + x.bound)
    at, first, bar = [0] * n, 0, 0
    results: list[tuple[int, int]] = []
    heap = [x[0] * n + i for i, x in enumerate(docs)]
    heapq.heapify(heap)
    while heap:
        code = heap[0]
        doc = code // n
        score, until = 0, (doc + 1) * n
        while code < until:
            i = code % n
            if i < first:  # left the heap's lists; looked up below from here on
                heapq.heappop(heap)
            else:
                p = at[i]
                score += addends[i][p]
                at[i] = p = p + 1
                if p < size[i]:
                    heapq.heapreplace(heap, docs[i][p] * n + i)
                else:
                    heapq.heappop(heap)
            if not heap:
                break
            code = heap[0]
        if score:
            for i in range(first - 1, -1, -1):
                if score + upto[i + 1] <= bar:
                    break
                p = at[i] = bisect_left(docs[i], doc, at[i])
                if p < size[i] and docs[i][p] == doc:
                    score += addends[i][p]
        if score > bar:
            if len(results) < k:
                heapq.heappush(results, (score, -doc))
            else:
                heapq.heapreplace(results, (score, -doc))
            if len(results) == k:
                bar = results[0][0]
                while first < n and upto[first + 1] <= bar:
                    first += 1
                if first == n:
                    break
    return sorted(((s, -d) for s, d in results), key=lambda x: (-x[0], x[1]))


def _search(n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for lists, items in zip(batch.column(0), batch.column(1), strict=True):
                rows = lists.as_py()
                ids, known, length = np.frombuffer(next(r["postings"] for r in rows if r["term"] is None), np.int64).reshape(3, -1)
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n // total
                ready: dict[str, _List] = {}
                for r in rows:
                    if r["term"] is not None:
                        both = decode(r["postings"])
                        d, tf = np.cumsum(both[0::2]), both[1::2]
                        x = r["w"] * (1_000_000_000 * tf // (1000 * tf + 8 * m[d]))
                        x, d = x[x > 0], d[x > 0]
                        if len(x):
                            ready[r["term"]] = _List(d.tolist(), x.tolist(), int(x.max()))
                for item in items.as_py():
                    own = [ready[t["term"]].times(t["times"]) for t in item["terms"] if t["term"] in ready]
                    found += [(item["item"], int(ids[d]) if known[d] else None, s) for s, d in best(own, k)]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return run


def _bytes(df: DataFrame, *columns: str) -> int:
    return df.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(16)))).first()[0] or 0


def search(spark: SparkSession, index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """items (item_id, text) over an index of `build` -> (item_id, rank, doc_id, score): each item's k best documents.

    With N documents that have a term, L terms in all, n terms in a document, df documents that hold a term: a term
    weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and adds w * ((10^9 tf) div (1000 tf + 8 m)) for each time that the item holds
    it, where m = 25 + (75 n N) div L. Only scores above 0 count; equal ones go by doc_id, null first. Items without
    terms, null texts among them, and items that nothing matches have no row. Rows that repeat an item_id, or have none, are
    items of their own. An empty table on either side gives no rows; further columns are ignored.
    """
    small_batches(spark)
    whole = index.where("term is null").agg(F.sum("df").alias("n"), F.sum("total").alias("total")).first()
    n, total = whole.n or 0, whole.total or 0
    own = table(spark, items.select("item_id", F.col("text").alias("body"), F.monotonically_increasing_id().alias("item")), "items")
    blocks = max(1, -(-own.count() // BLOCK_ITEMS))
    asked = own.select("item", F.explode(terms(F.col("body"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = table(spark, asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "asked")
    wanted = asked.select("term").distinct()
    small = _bytes(wanted, "term") <= BROADCAST_BYTES
    postings = index.where("term is not null")
    counts = postings.select("term", "df").join(F.broadcast(wanted) if small else wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = table(spark, counts.select("term", weight.alias("w")).where("w > 0"), "weights")
    need = table(spark, asked.select("block", "term").distinct().join(weights, "term"), "need")
    near = F.broadcast(need) if _bytes(need, "term") <= BROADCAST_BYTES else need
    lists = postings.select("shard", "term", "postings").join(near, "term").select("shard", "block", F.struct("term", "w", "postings").alias("list"))
    each = index.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    lists = lists.unionByName(each.select("shard", "block", F.struct("term", F.lit(0).cast("long").alias("w"), "postings").alias("list")))
    packs = lists.groupBy("shard", "block").agg(F.collect_list("list").alias("lists"))
    # a block's items are few; so are a shard's lists
    packed = asked.join(weights.select("term"), "term").groupBy("block", "item").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
    packed = packed.groupBy("block").agg(F.collect_list(F.struct("item", "terms")).alias("items"))
    packs = packs.join(F.broadcast(packed) if small and _bytes(asked, "term") <= BROADCAST_BYTES else packed, "block")
    found = table(spark, packs.select("lists", "items").mapInArrow(_search(n, total, k), "item long, doc_id long, score long"), "found")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = table(spark, own.select("item", "item_id").join(ranked, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    drop(own, asked, weights, need, found)
    return out
