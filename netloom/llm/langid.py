"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (n = 1 to 3, letters only, a word padded by one blank on
either side) in the order of their frequency, ties by n-gram code. A document's profile is compared with each language's by the
out-of-place distance: the sum over the document's n-grams of the difference of ranks, or the profile's length
for an n-gram that the language's profile lacks. The nearest language is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.store import small_batches
from netloom.llm.textops import text_buffers

PROFILE = 300
TRAIN_PER_LANG = 1500
_TOP = 0x110000


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter's code point (of a single character), 0 for others."""
    out = np.zeros(_TOP, np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters: list[np.ndarray] = []


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and letters (0 for anything else) of a chunk's texts, in code points."""
    if not _letters:
        _letters.append(_letter_table())
    offsets, data = text_buffers(texts)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return lead[offsets], _letters[0][chars]


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count), sorted by text and n-gram. An n-gram packs its letters in 21 bits each, blank is 1."""
    offsets, letters = code_points(texts)
    n = len(offsets) - 1
    own = np.repeat(np.arange(n), np.diff(offsets)).astype(np.int64)
    # drop repeated non-letters; one blank between words, around each text too
    gap = letters == 0
    edge = np.zeros(len(letters), bool)
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    keep = ~(gap & np.concatenate([[True], gap[:-1]])[: len(gap)] & ~edge)
    code = np.where(gap, 1, letters)[keep].astype(np.uint64)
    doc = own[keep]
    # a blank before and behind each text
    count = np.bincount(doc, minlength=n)
    at = np.arange(len(code)) + 2 * doc + 1
    full = np.ones(len(code) + 2 * n, np.uint64)
    full[at] = code
    doc = np.repeat(np.arange(n), count + 2)
    # letters are numbered inside the chunk, so that text number and n-gram share one sort key
    seen = np.unique(full) if len(full) < 1 << 16 else np.flatnonzero(np.bincount(full.astype(np.int64))).astype(np.uint64)
    bits = np.uint64(max(1, int(len(seen)).bit_length()))
    place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.uint64)
    place[seen.astype(np.int64)] = np.arange(1, len(seen) + 1)
    full = place[full.astype(np.int64)]
    blank = place[1] if len(place) > 1 else np.uint64(0)
    high = doc.astype(np.uint64) << (np.uint64(3) * bits)
    letter = full != blank
    keys = [(high | full)[letter]]
    if len(full) > 1:
        pair = full[:-1] << bits | full[1:]
        ok = (doc[:-1] == doc[1:]) & (letter[:-1] | letter[1:])
        keys.append((high[:-1] | pair)[ok])
        ok = (doc[:-2] == doc[2:]) & letter[1:-1]
        keys.append((high[:-2] | pair[:-1] << bits | full[2:])[ok])
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    size, key = np.diff(np.concatenate([first, [len(key)]])), key[first]
    # back to 21 bits a letter
    low = (np.uint64(1) << bits) - np.uint64(1)
    seen = np.concatenate([np.zeros(1, np.uint64), seen])
    gram = np.zeros(len(key), np.uint64)
    for k in (2, 1, 0):
        gram = gram << np.uint64(21) | seen[(key >> (bits * np.uint64(k)) & low).astype(np.int64)]
    return (key >> (np.uint64(3) * bits)).astype(np.int64), gram, size


def _ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size most frequent n-grams of each text: (text number, n-gram, rank from 0)."""
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    start = np.searchsorted(doc, np.arange(docs))
    rank = np.arange(len(doc)) - start[doc]
    keep = rank < size
    return doc[keep], gram[keep], rank[keep]


def _slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    offsets, _ = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = min(max(int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1, row + 1), n)
        yield column.slice(row, end - row)
        row = end


def train(docs: DataFrame, size: int = PROFILE, per_lang: int = TRAIN_PER_LANG) -> dict[str, np.ndarray]:
    """docs (doc_id, text, lang) -> for each language its profile: n-grams by rank.

    Of each language the documents whose hash of doc_id and text is in its lowest 1.25 * per_lang / n are learned from (n:
    the language's documents), so about 1.25 * per_lang of a large one and all of a small one. Rows of null lang or text
    are left out. The profiles are of fixed size, so they can be broadcast.
    """
    small_batches(docs.sparkSession)
    own = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and text is not null")
    # a share of the hashes, so that a language's rows needn't be brought together
    bound = own.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.25 * per_lang) / F.col("n"))
    own = own.join(F.broadcast(bound) if bound.count() < 10_000 else bound, "lang")
    own = own.where((F.col("h") / 2.0**64 + 0.5) <= share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            at = 0
            for part in _slices(batch.column(1)):
                d, g, c = gram_counts(part)
                here = lang[at : at + len(part)]
                at += len(part)
                for name in sorted(set(here)):
                    mine = (here == name)[d]
                    u, inverse = np.unique(g[mine], return_inverse=True)
                    total = np.bincount(inverse, c[mine], len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(total)], ["lang", "g", "c"])

    counts = own.select("lang", "text").mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "g")))
    top: dict[str, list[int]] = {}
    for r in ranked.where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        top.setdefault(r.lang, []).append(r.g)
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in top.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        d, g, c = gram_counts(texts)
        d, g, r = _ranked(d, g, c, n, self.size)
        lang, score = np.full(n, "und", object), np.zeros(n)
        if not self.langs or not len(g):
            return lang.tolist(), score
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == g, at, len(self.grams))
        known = np.bincount(d, minlength=n)
        place = self.rank[:, at]
        out = np.where(place < 0, self.size, np.abs(place - r))
        distance = np.stack([np.bincount(d, x, n) for x in out])
        has = known > 0
        best = distance.argmin(0)
        lang[has] = np.array(self.langs, object)[best[has]]
        score[has] = 1 - distance.min(0)[has] / (known[has] * self.size)
        return lang.tolist(), np.clip(score, 0, 1)


def identify(spark: SparkSession, docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score), one row for each row of docs.

    lang_pred is the language of the least distance, of equal ones the first by name; score is 1 less the distance's share of the
    largest possible one. Texts that are null or have no letter get `und` and 0, and so do all if there are no
    profiles. Rows are judged one by one, so repeats and further columns change nothing.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Profiles(profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang: list[str] = []
            score = [np.zeros(0)]
            for part in _slices(batch.column(1)):
                a, b = shared.value.predict(part)
                lang += a
                score.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate(score))], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
