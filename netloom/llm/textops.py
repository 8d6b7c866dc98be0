"""Vectorised words, hashes and n-grams over the UTF-8 buffers of Arrow string columns.

Everything works on a chunk of whole texts at once, with numpy on the bytes that Spark hands over, so no Python
object is made for a word. A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64 bit: a
polynomial in a fixed odd base over the word's bytes, then a finaliser; words of over LONG_WORD bytes take
xxhash64, because a polynomial modulo 2^64 can be attacked with very long strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
CHUNK_BYTES = 1 << 20
LONG_WORD = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                a = np.full(size, b, U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_bytes_pow, _gram_pow = Powers(_BASE), Powers(_GRAM)
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
LOWER_BYTE = _LOWER.astype(np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(1, np.int64), data[:0]
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes): runs of whole texts of about limit bytes; a longer text stands alone."""
    offsets, data = text_buffers(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


class Words:
    """The words of a chunk: start and end byte, text number and hash; first[d] is the first word of text d."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False, space: np.ndarray | None = None):
        """space: for each byte whether it stands between words; without it white space does."""
        n = len(data)
        self.docs = len(offsets) - 1
        if space is None:
            space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = edge[:n].copy()
        before[1:] |= space[:-1]
        after = edge[1:].copy()
        after[:-1] |= space[1:]
        word = ~space
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)
        up, down = _bytes_pow.get(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((_CODE_LOWER if lower else _CODE)[data] * up[:n], out=total[1:])
        length = self.end - self.start
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length.astype(U))
        for i in np.flatnonzero(length > LONG_WORD):
            raw = data[self.start[i] : self.end[i]]
            self.hash[i] = xxhash.xxh64_intdigest((LOWER_BYTE[raw] if lower else raw).tobytes())


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one text, and the word numbers at which the runs start."""
    size = len(words.hash)
    if size < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _gram_pow.get(size + 1)
    total = np.zeros(size + 1, U)
    np.cumsum(words.hash * up[:size], out=total[1:])
    at = np.flatnonzero(words.doc[: size - n + 1] == words.doc[n - 1 :])
    return mix((total[at + n] - total[at]) * down[at] + U(n)), at


def span_hash(words: Words, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the words start..end-1 (word numbers), with a polynomial base of its own for each seed."""
    size = len(words.hash)
    power = _span_pow.setdefault(seed, Powers(int(mix(np.array([seed + 77], U))[0]) | 1))
    up, down = power.get(size + 1)
    total = np.zeros(size + 1, U)
    np.cumsum(mix(words.hash + U(seed)) * up[:size], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


_span_pow: dict[int, Powers] = {}


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles: (text number, hash), sorted by both, and each text's set size.

    A text of fewer than n words has one shingle, its whole sequence; one without words has none.
    """
    h, at = grams(words, n)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(n - 1):
            has = words.count[short] > k
            whole[has] = mix(whole[has] * U(_GRAM) + words.hash[words.first[short[has]] + k] + U(k + 1))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return doc, h, np.bincount(doc, minlength=words.docs)


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def list_column(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def take_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = LOWER_BYTE) -> pa.Array:
    """The byte runs start..end-1 as an Arrow string column, each byte put through code (lower-casing A-Z)."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code[data[at]]))).cast(pa.string())
