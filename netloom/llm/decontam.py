"""Benchmark decontamination by the q-gram lemma.

An item of m bytes that occurs in a text with at most k edits shares at least m + 1 - Q * (k + 1) of its Q-grams with it, on
diagonals (text position less item position) that span at most k + 1. So hits are counted in diagonal bands of
width 2 (k + 1), one starting every k + 1, and bands that reach the bound are verified by a banded alignment.
Texts are compared with A-Z lower-cased and runs of white space (0x20, 0x09-0x0D) as one space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import small_batches, table
from netloom.llm.textops import LOWER_BYTE, SPACE, U, chunks

Q = 8
RATE = 0.1
MAX_ITEM_BYTES = 8 << 20
MAX_POSTINGS = 1 << 21
MAX_CELLS = 1 << 16
_BITS = 22
_MUL = U(0x9E3779B97F4A7C15)
_PLAIN = LOWER_BYTE.copy()
_PLAIN[SPACE] = 32


def _squeeze(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes with their texts' offsets, and for each byte its place in data."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(keep)
    return np.searchsorted(at, offsets), _PLAIN[data[at]], at


def _q_grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on as one number, exactly; as many as there are whole Q-grams."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    return np.ndarray((n,), "<u8", data.tobytes(), strides=(1,)).astype(U)


def normalise(text: str) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _squeeze(np.array([0, len(raw)]), raw)[1].tobytes().strip(b" ")


class Items:
    """Benchmark items: their Q-grams with postings, a bitmap that most other Q-grams miss, and edit budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.texts, self.short = [], [], []
        for item_id, text in items:
            raw = normalise(text)
            if len(raw) >= Q:
                self.ids.append(item_id)
                self.texts.append(np.frombuffer(raw, np.uint8))
            elif raw:
                self.short.append((item_id, raw))
        self.edits = np.array([min(int(rate * len(t)), len(t) // Q - 1) for t in self.texts], np.int64)
        self.least = np.array([len(t) + 1 - Q * (k + 1) for t, k in zip(self.texts, self.edits, strict=True)], np.int64)
        self.grams_of = np.array([len(t) + 1 - Q for t in self.texts], np.int64)
        grams = [_q_grams(t) for t in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, U)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.concatenate([first, [len(flat)]])
        self.item, self.place = item[order], place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.grams * _MUL) >> U(64 - _BITS)] = True

    def bands(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
        """(text number, item number, least and largest diagonal, whether the hits are in the item's front half) of the
        runs of bands that reach the bound.

        Hits are counted for texts that together have MAX_POSTINGS at most; of a text that has more by itself, items
        are counted first, so that memory doesn't follow the number of items that hold a q-gram.
        """
        g = _q_grams(data)
        hit = np.flatnonzero(self.bitmap[(g * _MUL) >> U(64 - _BITS)])
        if not len(hit) or not len(self.grams):
            return
        slot = np.searchsorted(self.grams, g[hit])
        slot[slot == len(self.grams)] = 0
        ok = self.grams[slot] == g[hit]
        hit, slot = hit[ok], slot[ok]
        doc = np.searchsorted(offsets, hit, "right") - 1
        inside = hit + Q <= offsets[doc + 1]
        hit, slot, doc = hit[inside], slot[inside], doc[inside]
        total = np.cumsum(self.first[slot + 1] - self.first[slot])
        a = 0
        while a < len(hit):
            held = total[a - 1] if a else 0
            b = int(np.searchsorted(total, held + MAX_POSTINGS, "right"))
            if b < len(hit):  # whole texts
                b = int(np.searchsorted(doc, doc[b]))
            if b > a:
                yield from self._runs(len(data), *self._postings(hit[a:b], slot[a:b], doc[a:b]))
            else:
                b = int(np.searchsorted(doc, doc[a], "right"))
                yield from self._runs_of_one(len(data), hit[a:b], slot[a:b], doc[a:b])
            a = b

    def _postings(self, hit: np.ndarray, slot: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, item, place in the item, diagonal) of each hit with each item that has its q-gram."""
        times = self.first[slot + 1] - self.first[slot]
        at = np.repeat(self.first[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        place = self.place[at]
        return np.repeat(doc, times), self.item[at], place, np.repeat(hit, times) - place

    def _runs_of_one(self, n: int, hit: np.ndarray, slot: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
        step = max(1, MAX_POSTINGS // int((self.first[slot + 1] - self.first[slot]).max()))
        pieces = [slice(a, a + step) for a in range(0, len(hit), step)]
        count = sum(np.bincount(self._postings(hit[p], slot[p], doc[p])[1], minlength=len(self.ids)) for p in pieces)
        group = np.where(count >= self.least, np.cumsum(np.where(count >= self.least, count, 0)) // MAX_POSTINGS, -1)
        for which in range(int(group.max()) + 1):
            parts = []
            for p in pieces:
                found = self._postings(hit[p], slot[p], doc[p])
                mine = group[found[1]] == which
                parts.append([x[mine] for x in found])
            yield from self._runs(n, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _runs(self, n: int, doc: np.ndarray, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
        if not len(doc):
            return
        # of a text only items with enough hits in all can reach the bound
        pair = doc * len(self.ids) + item
        base = int(doc[0]) * len(self.ids)
        if (int(doc[-1]) + 1) * len(self.ids) - base <= 4 * MAX_POSTINGS:
            keep = np.bincount(pair - base)[pair - base] >= self.least[item]
        else:  # the same without an array of texts times items
            _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
            keep = count[which] >= self.least[item]
        item, diagonal, place, pair = item[keep], diagonal[keep], place[keep], pair[keep]
        band = (diagonal + n) // (self.edits[item] + 1)
        key, which, count = np.unique(pair * (4 * n + 4) + band, return_inverse=True, return_counts=True)
        front = np.bincount(which, 2 * place < self.grams_of[item], len(key)) if len(key) else count
        after = np.zeros(len(key), np.int64)
        after[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        before = np.zeros(len(key), np.int64)
        before[1:] = np.where(key[1:] == key[:-1] + 1, count[:-1], 0)
        item = key // (4 * n + 4) % len(self.ids)
        good = np.maximum(after, before) + count >= self.least[item]
        key, item, front, count = key[good], item[good], front[good], count[good]
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1])[: len(key)])
        for a, b in zip(start, [*start[1:], len(key)], strict=True):
            i, w = int(item[a]), int(self.edits[item[a]]) + 1
            low, high = int(key[a] % (4 * n + 4)), int(key[b - 1] % (4 * n + 4))
            yield int(key[a] // (4 * n + 4)) // len(self.ids), i, low * w - n, (high + 1) * w - 1 - n, bool(2 * front[a:b].sum() >= count[a:b].sum())


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, anchor: int | None = None) -> tuple[int, int]:
    """Least edits of item against a piece of text inside the diagonals low..high, and the piece's end.

    The piece may start anywhere, or at text position anchor only. Among equal ends the first is taken.
    """
    far = len(item) + len(text) + 1
    c = np.arange(low, high + 1)
    row = np.where((c >= 0) & (c <= len(text)), 0, far) if anchor is None else np.where(c >= anchor, c - anchor, far)
    padded = np.full(len(text) + len(item) + 2 * len(c) + abs(low) + abs(high) + 2, -1, np.int16)
    base = abs(low) + len(c)
    padded[base : base + len(text)] = text
    step = np.arange(len(c))
    for i in range(1, len(item) + 1):
        j = c + i  # text position after this row
        new = row + (padded[base + low + i - 1 : base + low + i - 1 + len(c)] != item[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(j < 0) | (j > len(text))] = far
        row = np.minimum.accumulate(new - step) + step
        row[(j < 0) | (j > len(text))] = far
    best = int(row.argmin())
    return int(row[best]), int(c[best]) + len(item)


def last_rows(jobs: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> list[np.ndarray | None]:
    """For each (item, text, low, high, k) the edits of the whole item against a piece of text that ends on each of the
    diagonals low..high, or None if all are over k. Jobs of like size run side by side; one leaves once it is over k.
    """
    out: list[np.ndarray | None] = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda x: (len(jobs[x][0]), jobs[x][3] - jobs[x][2]))
    while order:
        some, cells = [], 0
        while order and (not some or cells <= MAX_CELLS and len(jobs[order[-1]][0]) * 2 > len(jobs[some[0]][0])):
            some.append(order.pop())
            cells = len(some) * max(jobs[x][3] - jobs[x][2] + 1 for x in (some[0], some[-1]))
        _run_side_by_side(jobs, np.array(some), out)
    return out


def _run_side_by_side(jobs: list[tuple], some: np.ndarray, out: list) -> None:
    sizes = np.array([len(jobs[x][0]) for x in some])
    lengths = np.array([len(jobs[x][1]) for x in some])
    low, k = (np.array([jobs[x][c] for x in some]) for c in (2, 4))
    widths = np.array([jobs[x][3] - jobs[x][2] + 1 for x in some])
    kind = np.int16 if sizes.max() + lengths.max() < 15000 else np.int32
    far = kind(sizes.max() + lengths.max() + 1)
    item = np.zeros((len(some), sizes.max()), np.uint8)
    for r, x in enumerate(some):
        item[r, : sizes[r]] = jobs[x][0]
    text = np.concatenate([jobs[x][1] for x in some] + [np.zeros(1, np.uint8)])
    begin = np.cumsum(lengths) - lengths
    step = np.arange(widths.max(), dtype=kind)
    c = low[:, None] + np.arange(widths.max())[None, :]  # text position before a row, less the row
    c[np.arange(widths.max())[None, :] >= widths[:, None]] = 1 << 40  # beyond the job's own width
    row = np.where((c >= 0) & (c <= lengths[:, None]), kind(0), far)
    for i in range(1, sizes.max() + 1):
        j = c + i
        inside = (j >= 1) & (j <= lengths[:, None])
        new = row + (text[np.where(inside, begin[:, None] + j - 1, len(text) - 1)] != item[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + kind(1))
        valid = (j >= 0) & (j <= lengths[:, None])
        new[~valid] = far
        row = np.minimum.accumulate(new - step, axis=1) + step
        row[~valid] = far
        np.minimum(row, far, out=row)
        done = sizes == i
        if done.any() or i % 8 == 0:
            least = row.min(1)
            for r in np.flatnonzero(done & (least <= k)):
                out[some[r]] = row[r, : widths[r]].astype(np.int64)
            stay = ~done & (least <= k)
            if not stay.any():
                return
            if not stay.all():
                some, sizes, lengths, k, begin, widths = (x[stay] for x in (some, sizes, lengths, k, begin, widths))
                item, c, row = item[stay], c[stay], row[stay]


def _places(item: np.ndarray, text: np.ndarray, ends: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) from (edits, end) of the possible ends: the fewest edits first, then the first in the text;
    a piece that overlaps one taken before is the same place."""
    taken: list[tuple[int, int, int]] = []
    for edits, end in sorted(ends):
        if all(end <= s or end - (len(item) - k) >= e for s, e, _ in taken):
            near = text[max(0, end - len(item) - k - 1) : end]
            start = end - (banded(item[::-1], near[::-1], -k, k, anchor=0)[1] if edits else len(item))
            if all(end <= s or start >= e for s, e, _ in taken):
                taken.append((start, end, edits))
    return taken


def find_items(items: Items, offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, edits): places in data's bytes, none of which overlaps another of its item."""
    offs, plain, at = _squeeze(offsets, data)
    at = np.concatenate([at, [len(data)]])
    out = []
    todo: list[tuple] = []
    for found in items.bands(offs, plain):
        todo.append(found)
        if len(todo) == 4096:
            out += _verified(items, todo, offs, plain)
            todo = []
    out += _verified(items, todo, offs, plain)
    for i, raw in enumerate(r for _, r in items.short):
        for doc in range(len(offs) - 1):
            text = plain[offs[doc] : offs[doc + 1]].tobytes()
            found = text.find(raw)
            while found >= 0:
                a = int(offs[doc]) + found
                out.append((doc, items.short[i][0], a, a + len(raw), 0))
                found = text.find(raw, found + len(raw))
    return sorted({(doc, item_id, int(at[a]), int(at[b - 1]) + 1, edits) for doc, item_id, a, b, edits in out})


def _verified(items: Items, todo: list[tuple[int, int, int, int, bool]], offs: np.ndarray, plain: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Aligns the candidates, those whose hits are all in front from the back first: there it shows sooner that
    the rest is missing."""
    jobs = []
    for doc, i, low, high, _ in todo:
        k = int(items.edits[i])
        left = max(int(offs[doc]), low - k)
        text = plain[left : max(left, min(int(offs[doc + 1]), high + len(items.texts[i]) + k))]
        jobs.append((items.texts[i], text, low - k - left, high + k - left, k, left))
    # where all ends of a run are so close that they are one place, an exact copy is that place
    found: dict[tuple[int, int], dict[int, int]] = {}
    settled = set()
    for x, (item, text, low, high, k, left) in enumerate(jobs):
        if high - low < len(item) - k and (at := text.tobytes().find(item.tobytes())) >= 0:
            settled.add(x)
            found.setdefault(todo[x][:2], {})[left + at + len(item)] = 0
    back = [x for x, run in enumerate(todo) if run[4] and x not in settled]
    ends = []
    for x in back:
        item, text, low, high, k, _ = jobs[x]
        shift = len(text) - len(item)
        ends.append((item[::-1], text[::-1], shift - high, shift - low, k))
    gone = {x for x, row in zip(back, last_rows(ends), strict=True) if row is None}
    alive = [x for x in range(len(jobs)) if x not in gone and x not in settled]
    for x, row in zip(alive, last_rows([jobs[x][:5] for x in alive]), strict=True):
        if row is None:
            continue
        item, _, low, _, k, left = jobs[x]
        mine = found.setdefault(todo[x][:2], {})
        for c in np.flatnonzero(row <= k):
            end = left + low + len(item) + int(c)
            mine[end] = min(mine.get(end, k), int(row[c]))
    out = []
    for (doc, i), mine in found.items():
        first = int(offs[doc])
        for start, end, edits in _places(items.texts[i], plain[first : int(offs[doc + 1])], [(e, end - first) for end, e in mine.items()], int(items.edits[i])):
            out.append((doc, items.ids[i], first + start, first + end, edits))
    return out


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, start, end, edits), a row for each place.

    An item is in a text if some piece of it is at most floor(rate * m) edits from the item (m: its normalised
    bytes), or m // Q - 1 if that is less: items of under 40 bytes get fewer edits, those of under Q bytes none. start
    and end count code points. Null and empty texts and items match nothing, an empty table gives no rows, repeated
    rows are judged one by one, further columns are ignored. Places of one item don't overlap: the one of fewest edits
    counts, then the first. Texts are whole, however long. The items are broadcast in parts of about MAX_ITEM_BYTES,
    each of which is one pass over docs that is written before the next part is sent.
    """
    small_batches(spark)
    own = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // MAX_ITEM_BYTES) or 1
    found = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in some.orderBy("item_id", "text").collect()]))
        one = own.mapInArrow(_scan(shared, rate), "doc_id long, item_id long, start long, end long, edits int")
        if parts > 1:  # one part is held at a time
            one = table(spark, one, "places")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return found


#: the index of this worker, by broadcast, so that a worker builds it once for all of its tasks
_built: dict[str, Items] = {}


def _index(key: str, items: list[tuple], rate: float) -> Items:
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, rate)
    return _built[key]


def _scan(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _index(*shared.value, rate)
        for batch in batches:
            ids = batch.column(0)
            for row, end, offsets, data in chunks(batch):
                found = find_items(made, offsets, data)
                if found:
                    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    doc, item, a, b, edits = map(np.array, zip(*found, strict=True))
                    first = lead[offsets[doc]]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(row, end - row).take(pa.array(doc)), pa.array(item), pa.array(lead[a] - first), pa.array(lead[b] - first), pa.array(edits.astype(np.int32))],
                        ["doc_id", "item_id", "start", "end", "edits"],
                    )

    return run
