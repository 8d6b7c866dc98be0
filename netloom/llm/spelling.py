"""Grouping of spelling variants: letter-parity masks in three bands, verified candidates, forms and their roots.

Words are counted over all texts by vectorised hashing of whole chunks; a task adds up equal words before anything is
shuffled. A word's mask has a bit for each letter that occurs an odd number of times; letters are dealt to three bands.
One inserted, deleted or replaced letter flips at most two bits, so at least one of the bands stays as it is: words
that are one edit apart meet in an equal band. One edit also leaves the front or the back half of a word alone, so a
band is joined together with that half and the length, which keeps common bands (letters that hardly any word has) small
without losing a pair. What meets is compared by mask and then by edit distance.

A word's form is its most frequent near word of at least RATIO times its count. Forms are more frequent than what points
to them, so following them ends, and jumps are doubled until nothing moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import drop, small_batches, table
from netloom.llm.textops import LOWER_BYTE, Words, chunks, take_strings

RATIO = 5
MIN_LENGTH = 6
MIN_COUNT = 5
BANDS = 3
#: distinct words of a task that are held before they are passed on
HELD = 1 << 18
#: runs longer than this have their checksums taken one by one
LONG_RUN = 48


def _crc_table() -> np.ndarray:
    """The checksum step of each byte, from the polynomial 0xEDB88320."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def run_checksums(prefixes: list[bytes], words: Words, lower: np.ndarray) -> np.ndarray:
    """CRC-32 of each word with its text's prefix before it. lower: the chunk's bytes, lower-cased."""
    state = np.array([zlib.crc32(p) for p in prefixes] or [0], np.uint32)[words.doc] ^ np.uint32(0xFFFFFFFF)
    size = words.end - words.start
    short = np.flatnonzero(size <= LONG_RUN)
    for k in range(int(size[short].max(initial=0))):
        if k:
            short = short[size[short] > k]
        s = state[short]
        state[short] = _CRC[(s ^ lower[words.start[short] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_RUN):
        state[i] = zlib.crc32(lower[words.start[i] : words.end[i]].tobytes(), zlib.crc32(prefixes[words.doc[i]]))
    return state


def latin_runs(data: np.ndarray) -> np.ndarray:
    """For each byte whether it is outside of the runs [A-Za-z\\u00C0-\\u00FF]+: in UTF-8 the latter letters are 0xC3 and one more byte."""
    lead = data == 0xC3
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | lead
    letter[1:] |= lead[:-1]
    return ~letter


def _counter(divisor: int):
    def merge(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, end, offsets, data in chunks(batch):
                w = Words(offsets, data, lower=True, space=latin_runs(data))
                lower = LOWER_BYTE[data]
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                points = lead[w.end] - lead[w.start]
                crc = run_checksums([f"{'' if i is None else i}:".encode() for i in ids[row:end]], w, lower)
                hit = crc % np.uint32(divisor) == 0
                changed = []
                for i in np.flatnonzero(hit & (points > MIN_LENGTH)):
                    run_ = lower[w.start[i] : w.end[i]].tobytes().decode()
                    k = int(crc[i]) % len(run_)
                    changed.append(run_[:k] + run_[k + 1 :])
                use = np.flatnonzero(~hit & (points >= MIN_LENGTH))
                _, first, n = np.unique(w.hash[use], return_index=True, return_counts=True)
                at = use[first]
                held.append(pa.table({"word": take_strings(lower, w.start[at], w.end[at]), "n": pa.array(n.astype(np.int64))}))
                if changed:
                    held.append(pa.table({"word": pa.array(changed, pa.string()), "n": pa.array(np.ones(len(changed), np.int64))}))
            if len(held) > 1 and sum(map(len, held)) > 4 * HELD:
                held = [merge(held)]
                if len(held[0]) > 2 * HELD:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from merge(held).to_batches(max_chunksize=1 << 16)

    return run


def count_words(spark: SparkSession, docs: DataFrame, divisor: int = 199) -> DataFrame:
    """docs (doc_id, text) -> (word, n): words of at least MIN_LENGTH code points that occur MIN_COUNT times or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. Where divisor divides
    h = CRC-32 of `<doc_id>:<word>`, the code point h % length is left out, as a slip of the pen would. Null texts
    have no words, a null doc_id is an empty string, repeated rows count again. Inside a chunk of about a megabyte
    words are told apart by a 64-bit hash, elsewhere by themselves.
    """
    small_batches(spark)
    counts = docs.select("doc_id", "text").mapInArrow(_counter(divisor), "word string, n long")
    return table(spark, counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT), "words")


def masks(words: list[str]) -> np.ndarray:
    """Parities of the letters in BANDS words of 30 bits each: letter c has bit (c // 3) % 30 of band c % 3."""
    out = np.zeros((len(words), BANDS), np.int32)
    size = np.array([len(x) for x in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), size)
    np.bitwise_xor.at(out, (of, letters % BANDS), np.int32(1) << (letters // BANDS % 30).astype(np.int32))
    return out


def near_pairs(spark: SparkSession, words: DataFrame) -> DataFrame:
    """words (word, n), unique -> (a, b, na, nb): pairs that differ by one inserted, deleted or replaced code point, once
    each, the shorter one first, of equal lengths the smaller. Null words are near nothing. Any letters will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            m = masks(own)
            columns = [pa.array([len(x) for x in own], pa.int32()), *(pa.array(m[:, k]) for k in range(BANDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["word", "n", "size", *(f"m{k}" for k in range(BANDS))])

    known = words.select("word", F.col("n").cast("long")).where("word is not null")
    known = known.mapInArrow(run, "word string, n long, size int, " + ", ".join(f"m{k} int" for k in range(BANDS)))
    known = table(spark, known, "masks")

    def keys(longer: int) -> DataFrame:
        """A row for each band and half of a word that is compared as the longer one, of `longer` letters more."""
        least = F.col("size") - longer
        half = F.floor(least / 2).cast("int")
        front, back = F.substring("word", F.lit(1), half), F.substring("word", F.col("size") - (least - half) + 1, least - half)
        bands = [F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("bits"), F.lit(side).alias("side"), part.alias("half")) for k in range(BANDS) for side, part in enumerate((front, back))]
        return known.withColumn("least", least).withColumn("front", front).withColumn("key", F.explode(F.array(*bands)))

    own, same = ["band", "bits", "side", "half", "least"], ["word", "n", "front", *(f"m{k}" for k in range(BANDS))]
    short = keys(0).select("key.*", *same, "least", F.lit(0).alias("more"))
    other = short.withColumn("more", F.lit(0)).unionByName(keys(1).select("key.*", *same, "least", F.lit(1).alias("more")))
    a = short.select(*own, *[F.col(c).alias(f"a_{c}") for c in same])
    b = other.select(*own, "more", *[F.col(c).alias(f"b_{c}") for c in same])
    # a pair counts in its first equal band, and there by its front half if that is equal
    first = F.lit(True)
    for k in range(BANDS - 1):
        first = first & ((F.col("band") <= k) | (F.col(f"a_m{k}") != F.col(f"b_m{k}")))
    first = first & ((F.col("side") == 0) | (F.col("a_front") != F.col("b_front")))
    flips = sum((F.bit_count(F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}"))) for k in range(BANDS)), F.lit(0))
    pairs = a.join(b, own).where(((F.col("more") == 1) | (F.col("a_word") < F.col("b_word"))) & (flips <= 2) & first)
    pairs = pairs.where(F.levenshtein("a_word", "b_word", 1) == 1)
    out = table(spark, pairs.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), F.col("a_n").alias("na"), F.col("b_n").alias("nb")), "near")
    drop(known)
    return out


def group_variants(spark: SparkSession, words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n), unique -> (word, form, root, n, n_near, form_n), one row for each word.

    n_near counts the near words. form is the near word of the largest n, of equal ones the smallest by code points, if
    that n is at least ratio times the word's own; form_n is its n; both are null without one. root is what following
    forms ends at, the word itself if it has none. An empty table gives no rows; further columns are ignored.
    """
    pairs = near_pairs(spark, words)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.min("n").alias("n"))
    best = best.withColumn("form_n", -F.col("best.less")).withColumn("has", F.col("form_n") >= ratio * F.col("n"))
    best = table(spark, best.select("word", "n_near", F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "forms")

    jumps = table(spark, best.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        far = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = table(spark, jumps.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        moved = not new.where("moved").isEmpty()
        drop(jumps)
        jumps = new.select("word", "root")
        jumps.netloom_path = new.netloom_path
        if not moved:
            break
    out = words.select("word", F.col("n").cast("long")).join(best, "word", "left").join(jumps, "word", "left")
    out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    out = table(spark, out, "variants")
    drop(pairs, best, jumps)
    return out
