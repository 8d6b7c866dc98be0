"""Removal of repeated passages: suffix automata for a bounded reference, routed window spans for a whole corpus.

`remove_reference` broadcasts suffix automata of the reference's shards, streams each text through them for its
matching statistics and removes the maximal spans above the threshold. A corpus against itself can't be done so:
every text would have to pass every shard. `repeated_windows` finds the same windows exactly with shuffles only:

1. each window of `words` words has a minimizer, the least hash of its runs of GRAM words. Equal windows have
   equal minimizers, so neighbouring windows with one minimizer form a row (m, hash of their whole span).
2. spans that occur twice are repeated in full; they are counted with partial aggregation.
3. where a minimizer has several different spans, each distinct span is opened into its windows once, weighted by
   its count, and windows are counted by (m, window hash).

So about one row for each twelve words is shuffled, and single windows only at the edges of shared passages.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.store import drop, small_batches, table
from netloom.llm.textops import U, Words, chunks, grams, int64, span_hash

GRAM = 12
MAX_SHARD_WORDS = 200_000
MAX_REFERENCE_WORDS = 4_000_000


class SuffixAutomaton:
    """All substrings of some word sequences; a sequence ends with a mark of its own, so no match runs across."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for number, words in enumerate(sequences):
            for w in [*words, ("end", number)]:
                last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
        return state

    def matching_statistics(self, words: list) -> list[int]:
        """For each word the length of the longest match that ends there."""
        state = size = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def covered(ends: list[int], least: int) -> np.ndarray:
    """Words covered by matches of at least `least` words, from the matching statistics."""
    mark = np.zeros(len(ends) + 1, np.int64)
    for i, size in enumerate(ends):
        if size >= least:
            mark[i + 1 - size] += 1
            mark[i + 1] -= 1
    return np.cumsum(mark[:-1]) > 0


#: the automata of this worker, by broadcast, so that a worker builds them once for all of its tasks
_built: dict[str, list[SuffixAutomaton]] = {}


def _automata(key: str, shards: list[list[list[bytes]]]) -> list[SuffixAutomaton]:
    if key not in _built:
        _built.clear()
        _built[key] = [SuffixAutomaton(s) for s in shards]
    return _built[key]


def remove_reference(spark: SparkSession, docs: DataFrame, reference: DataFrame, words: int = 50) -> DataFrame:
    """docs (doc_id, text), reference (text) -> (doc_id, text, n_removed): spans of `words` words or more that stand
    in the reference are cut.

    The reference must be of at most MAX_REFERENCE_WORDS words (it is broadcast); for more, append it to docs and use
    `repeated_windows`. It is cut into shards of MAX_SHARD_WORDS, each an automaton of its own. Null texts stay
    null; an empty reference removes nothing; repeated rows are judged one by one.
    """
    small_batches(spark)
    count = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    total = reference.where("text is not null").agg(F.sum(count)).first()[0] or 0
    if total > MAX_REFERENCE_WORDS:
        raise ValueError(f"the reference has {total} words; at most {MAX_REFERENCE_WORDS} can be broadcast")
    shards: list[list[list[bytes]]] = [[]]
    held = 0
    for r in reference.where("text is not null").select("text").distinct().orderBy("text").collect():
        sequence = r.text.encode().split()
        if held + len(sequence) > MAX_SHARD_WORDS and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(sequence)
        held += len(sequence)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automata(*shared.value)
        for batch in batches:
            out, removed = [], []
            for text in batch.column(1).to_pylist():
                own = (text or "").encode().split()
                gone = np.zeros(len(own), bool)
                for automaton in made:
                    gone |= covered(automaton.matching_statistics(own), words)
                removed.append(int(gone.sum()))
                out.append(text if not gone.any() else cut(text.encode(), gone).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_removed"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, text string, n_removed long")


def cut(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words and the white space behind them; other white space stays."""
    data = np.frombuffer(raw, np.uint8)
    w = Words(np.array([0, len(data)]), data)
    until = np.concatenate([w.start[1:], [len(data)]])
    keep = np.zeros(len(data) + 1, np.int64)
    np.add.at(keep, w.start[gone], 1)
    np.add.at(keep, until[gone], -1)
    return data[np.cumsum(keep[:-1]) == 0].tobytes().rstrip(b" \t\n\x0b\x0c\r") if gone.any() else raw


def _spans(words: int):
    width = words - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hash = batch.column(0), batch.column(1)
            for row, end, offsets, data in chunks(batch):
                w = Words(offsets, data)
                n = len(w.hash) - words + 1
                if n <= 0:
                    continue
                start = np.flatnonzero(w.doc[:n] == w.doc[words - 1 :])
                if not len(start):
                    continue
                g = np.full(len(w.hash), ~U(0), U)
                h, at = grams(w, GRAM)
                g[at] = h
                low, have = g, 1
                while 2 * have <= width:
                    low, have = np.minimum(low[:-have], low[have:]), 2 * have
                low = np.minimum(low[: n], low[width - have : width - have + n])
                twice = np.zeros(len(g), np.int64)
                for d in range(1, width + 1):
                    twice[:-d] |= g[d:] == g[:-d]
                twice = np.concatenate([[0], np.cumsum(twice)])
                m = low[start]
                new = np.concatenate([[True], (m[1:] != m[:-1]) | (np.diff(start) != 1) | (w.doc[start[1:]] != w.doc[start[:-1]])])
                first = np.flatnonzero(new)
                count = np.diff(np.concatenate([first, [len(start)]]))
                a = start[first]
                doc = w.doc[a]
                periodic = twice[np.minimum(a + count + width, len(g))] > twice[a]
                yield pa.RecordBatch.from_arrays(
                    [
                        int64(m[first]), int64(span_hash(w, a, a + count - 1 + words, 1)), ids.slice(row, end - row).take(pa.array(doc)), text_hash.slice(row, end - row).take(pa.array(doc)),
                        pa.array((a - w.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(periodic),
                    ],
                    ["m", "s", "doc_id", "th", "at", "n", "periodic"],
                )

    return run


def _open_windows(words: int):
    """(doc_id, th, text, spans of m, s, at, n, times) -> a row for each window: (m, s, i, w, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1)
            for row, end, offsets, data in chunks(batch):
                w = Words(offsets, data)
                own = spans.slice(row, end - row)
                sizes = np.diff(own.offsets.to_numpy())
                flat = own.flatten()
                get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
                n = get("n").astype(np.int64)
                a = get("at").astype(np.int64) + np.repeat(w.first[:-1], sizes)
                which = np.repeat(np.arange(len(n)), n)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = a[which] + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("m")[which]), pa.array(get("s")[which]), pa.array(i.astype(np.int32)), int64(span_hash(w, start, start + words, 2)), pa.array(get("times")[which])],
                    ["m", "s", "i", "w", "times"],
                )

    return run


def repeated_windows(spark: SparkSession, docs: DataFrame, words: int = 50) -> DataFrame:
    """docs (doc_id, th, text) -> (doc_id, th, spans): the starts of windows that also start anywhere else.

    A window is `words` consecutive words of one text. No doc_id may be null. spans is an array of (at, n): n window starts from word `at`
    on. th is a 32-bit hash of the text, which tells rows of one doc_id apart; a text without such a window has no row. Rows that repeat (doc_id, th) count as
    rows of their own, so their windows are all repeated.
    """
    if words <= GRAM:
        raise ValueError(f"windows need more than {GRAM} words")
    schema = "m long, s long, doc_id long, th int, at int, n int, periodic boolean"
    rows = table(spark, docs.select("doc_id", "th", "text").mapInArrow(_spans(words), schema), "spans")
    spans = table(spark, rows.groupBy("m", "s").agg(F.count("*").cast("int").alias("times"), F.max("periodic").alias("periodic")), "counted")
    # of a minimizer's spans some may overlap in part: if they differ and one occurs once, or if one repeats itself
    mixed = spans.groupBy("m").agg(F.count("*").alias("kinds"), F.min("times").alias("least"), F.max("periodic").alias("periodic"))
    mixed = table(spark, mixed.where("least = 1 and (kinds > 1 or periodic)").select("m", F.lit(True).alias("mixed")), "mixed")
    kept = spans.join(mixed, "m", "left").where("times > 1 or mixed").select("m", "s", "times", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    kept = table(spark, kept, "kept")
    placed = table(spark, rows.drop("periodic").join(kept, ["m", "s"]), "placed")
    drop(rows, spans, mixed, kept)

    one = placed.where("mixed").groupBy("m", "s", "times").agg(F.min(F.struct("doc_id", "th", "at", "n")).alias("rep")).select("m", "s", "times", "rep.*")
    opened = table(spark, one.groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "s", "at", "n", "times")).alias("spans")), "opened")
    texts = docs.select("doc_id", "th", "text").join(opened, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    windows = table(spark, texts.select("text", "spans").mapInArrow(_open_windows(words), "m long, s long, i int, w long, times int"), "windows")
    often = table(spark, windows.groupBy("m", "w").agg(F.sum("times").alias("times")).where("times > 1").select("m", "w"), "often")
    partial = windows.where("times = 1").join(often, ["m", "w"]).groupBy("m", "s").agg(F.collect_list("i").alias("starts"))
    # a span that occurs once is in one place; the others are repeated in full
    ones = placed.where("times = 1").select("m", "s", "doc_id", "th", "at").join(partial, ["m", "s"])
    ones = ones.select("doc_id", "th", "at", F.explode("starts").alias("i")).select("doc_id", "th", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"))
    full = placed.where("times > 1").select("doc_id", "th", "at", "n")
    out = full.unionByName(ones).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("spans"))
    out = table(spark, out, "repeats")
    drop(placed, opened, windows, often)
    return out


def _removal(words: int, with_text: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), batch.column(1)
            for row, end, offsets, data in chunks(batch):
                w = Words(offsets, data)
                own = spans.slice(row, end - row).fill_null([])
                sizes = np.diff(own.offsets.to_numpy())
                flat = own.flatten()
                a = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], sizes)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                mark = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(mark, a, 1)
                np.add.at(mark, a + n + words - 1, -1)
                gone = np.cumsum(mark)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                texts, digests = [], []
                for d in range(end - row):
                    raw = data[offsets[d] : offsets[d + 1]]
                    mine = gone[w.first[d] : w.first[d + 1]]
                    if with_text:
                        texts.append(cut(raw.tobytes(), mine).decode() if removed[d] else raw.tobytes().decode())
                    else:
                        digests.append(hashlib.sha256(b" ".join(x for x, g in zip(raw.tobytes().split(), mine, strict=True) if not g) if removed[d] else b" ".join(raw.tobytes().split())).hexdigest())
                columns = [ids.slice(row, end - row), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts if with_text else digests, pa.string())]
                columns += [batch.column(3 + k).slice(row, end - row) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256", *carry])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, words: int = 50, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_removed, text or kept_sha256), one row for each row of docs.

    Each word that is covered by a window of `words` words whose sequence also starts anywhere else in the corpus,
    the same text included, is removed; windows are judged on the input. Without with_text the result holds the
    sha256 of the kept words joined by one space instead of the text. Null and empty texts have no words; texts of
    fewer words than a window lose nothing and stay as they are; repeated rows are other places, so what they share
    goes from all. Rows of a null doc_id are told apart by their texts. Texts are whole, however long. Columns named in
    carry are passed on, others are ignored; an empty table gives no rows.
    """
    small_batches(spark)
    if clash := {"doc_id", "n_words", "n_removed", "text", "kept_sha256"} & set(carry):
        raise ValueError(f"columns that the result has itself can't be carried: {sorted(clash)}; pass them in a struct")
    more = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("th", F.shiftright(F.xxhash64("text"), 32).cast("int"))
    own = own.withColumn("id", F.coalesce("doc_id", F.xxhash64("text")))
    spans = repeated_windows(spark, own.select(F.col("id").alias("doc_id"), "th", "text"), words)
    both = own.join(spans.withColumnRenamed("doc_id", "id"), ["id", "th"], "left").select("doc_id", "spans", "text", *[f"_{i}" for i in range(len(carry))])
    kinds = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("text" if with_text else "kept_sha256", "string")
    for c in carry:
        kinds = kinds.add(c, docs.schema[c].dataType)
    return both.mapInArrow(_removal(words, with_text, list(carry)), kinds)
