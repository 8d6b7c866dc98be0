"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its words (weight: how often). For each of K samples every word gets
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; with t = floor(ln weight / r + b) its value is
c * exp(-r * (t - b + 1)), and the sample is the (word, t) of the least value. Two documents agree in a sample with a probability equal
to their generalised Jaccard similarity: the sum of the least weights over the sum of the largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import small_batches, table
from netloom.llm.textops import U, Words, chunks, mix

SAMPLES = 64
_STEP = 32768


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 1/2) / n: x with 1 - (1 + x) e^-x = p, by Newton steps."""
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-9)
    return x


_GAMMA = _gamma_quantiles(1 << 16)
_LOG_GAMMA = np.log(_gamma_quantiles(1 << 20)).astype(np.float32)
_GAMMA = _GAMMA.astype(np.float32)
_SEED = mix(np.arange(1, SAMPLES + 1, dtype=U))


def term_weights(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, count), sorted by text."""
    w = Words(offsets, data)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)])
    return d[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def _keys(term: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """For terms with their weights a row of SAMPLES values: 32 bits of order above 32 bits that name the sample."""
    x = mix(term[:, None] ^ _SEED[None, :])
    r = _GAMMA[(x >> U(48)).astype(np.int32)]
    log_c = _LOG_GAMMA[((x >> U(28)) & U(0xFFFFF)).astype(np.int32)]
    b = (x & U(0xFFFFFFF)).astype(np.float32) * np.float32(2.0**-28)
    t = np.floor(log_weight[:, None] / r + b)
    value = log_c - r * (t - b + np.float32(1))
    bits = value.view(np.int32)
    out = np.empty((*x.shape, 2), np.uint32)  # little-endian halves of 64 bits
    out[..., 1] = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.uint32) ^ np.uint32(1 << 31)  # floats' order
    x >>= U(7)
    x ^= t.astype(np.int32).astype(U) * U(0x9E3779B1)
    x *= U(0xD6E8FEB86659FD93)
    out[..., 0] = x >> U(32)
    return out.view(U)[..., 0]


def signatures(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Samples (texts x SAMPLES, uint32); an empty text's are all 0. Texts that share words and weights share the work
    on them, so related texts should stand side by side."""
    doc, term, count = term_weights(offsets, data)
    best = np.full((len(offsets) - 1, SAMPLES), ~U(0), U)
    logs = np.log(count).astype(np.float32)
    both = term + mix(count.astype(U))
    for at in range(0, len(doc), _STEP):
        d = doc[at : at + _STEP]
        _, first, which = np.unique(both[at : at + _STEP], return_index=True, return_inverse=True)
        key = np.empty((len(first), SAMPLES), U)
        for i in range(0, len(first), 1024):  # small enough for the processor's cache
            some = at + first[i : i + 1024]
            key[i : i + 1024] = _keys(term[some], logs[some])
        start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        for a, b in zip(start, [*start[1:], len(d)], strict=True):
            np.minimum(best[d[a]], key[which[a:b]].min(0), out=best[d[a]])
    full = np.zeros(len(offsets) - 1, bool)
    full[doc] = True
    out = (best & U(0xFFFFFFFF)).astype(np.uint32)
    out[~full] = 0
    return out


def as_bytes(signature: np.ndarray) -> bytes:
    """16 bits a sample; the empty document's fingerprint is empty."""
    return signature.astype(">u2").tobytes() if signature.any() else b""


def as_text(signature: np.ndarray) -> str:
    """The fingerprint in hexadecimal."""
    return as_bytes(signature).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples; two empty documents are alike, an empty and another one are not."""
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return float(np.mean((a & 0xFFFF) == (b & 0xFFFF)))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint), one row for each row. Null and empty texts give ''; equal texts
    equal fingerprints; further columns are ignored."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in chunks(batch):
                out = [as_text(s) for s in signatures(offsets, data)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def ranges(rows: int, least: int = 4000, most: int = 100_000, tasks: int = 2000) -> int:
    """How many ranges of documents: of `least` rows each up to that many tasks, then no more until a range has `most` rows."""
    return max(1, -(-rows // most), min(-(-rows // least), tasks))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) -> (part, doc_id, text), each part a range, sorted by (doc_id, hash of text, text), nulls first.

    The parts follow each other. A running number makes the ranges also cut rows that repeat one id and text, so that no
    part gets them all; texts themselves are never sampled for the cuts.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    own = own.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h", "row")
    own = own.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    return own.select(F.spark_partition_id().alias("part"), "doc_id", "text")


_ROW = "part int, edge int, doc_id long, n_chars long, edited binary, own binary, new binary, near_edited double, near_next double, text string"


def compare_edits(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first
    ones (or all of them). The next document is the one after by (doc_id, xxhash64 of the text, text), nulls first, and
    the first after the last; a table of one row follows itself, repeated rows follow each other. Null texts are empty;
    an empty table gives no rows; further columns are ignored.

    Each task compares the rows of one range and keeps its first and its last text; these are joined with the next
    range's first, so texts are shuffled once and no window over all rows is needed.
    """
    small_batches(spark)
    parts = parts or ranges(docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            part, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = list(zip(part, ids, texts, strict=True))
            if not held and rows:
                yield _edge(rows[0], 1)
            rows = held + rows
            held = rows[-1:]
            yield from _compare(rows)
        if held:
            yield _edge(held[0], 2)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _compare([(part, doc_id, text), (part, None, following)])

    rows = table(spark, in_order(docs, parts).mapInArrow(run, _ROW), "compared")
    # one row for each range: its first and its last text; the number of ranges is known, so one task orders them
    borders = rows.where("edge > 0").groupBy("part").agg(F.max(F.when(F.col("edge") == 1, F.col("text"))).alias("head"), F.max(F.when(F.col("edge") == 2, F.struct("doc_id", "text"))).alias("tail"))
    borders = table(spark, borders, "borders")
    order = sorted(r.part for r in borders.select("part").collect())
    after = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, next int")
    heads = borders.select(F.col("part").alias("next"), F.col("head").alias("following"))
    lasts = borders.join(after, "part").join(heads, "next").select("part", "tail.doc_id", "tail.text", "following")
    out = rows.where("edge = 0").unionByName(lasts.mapInArrow(close, _ROW))
    print_of = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", "n_chars", print_of("edited").alias("edited_sha256"), print_of("own").alias("fingerprint"), print_of("new").alias("edited_fingerprint"), "near_edited", "near_next"
    )


def _edge(row: tuple, kind: int) -> pa.RecordBatch:
    values = [row[0], kind, row[1], *[None] * 6, row[2]]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)


_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in _ROW.split(", ")]


def _signed(texts: list[str]) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    return np.concatenate([signatures(offsets, data) for _, _, offsets, data in chunks(batch)] or [np.zeros((0, SAMPLES), np.uint32)])


def _compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text) in order, each compared with the one after it; the last row is only a successor."""
    for at in range(0, len(rows) - 1, 256):
        some = rows[at : at + 257]
        texts = [r[2] for r in some]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
        n = len(edited)
        signed = _signed([t for pair in zip(texts, [*edited, ""], strict=True) for t in pair])  # each text beside its edit
        own, new = signed[0::2], signed[1::2]
        columns = [
            [r[0] for r in some[:n]], [0] * n, [r[1] for r in some[:n]], [len(t) for t in texts[:n]], [hashlib.sha256(t.encode()).digest() for t in edited],
            [as_bytes(x) for x in own[:n]], [as_bytes(x) for x in new[:n]], [likeness(own[i], new[i]) for i in range(n)], [likeness(own[i], own[i + 1]) for i in range(n)], [None] * n,
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)
