"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A sketch has `bins` coordinates. In round i every shingle is thrown into one hashed bin with value (i, hash);
after `bins` rounds, round bins + j puts all shingles into bin j, so that each coordinate is filled whatever the
set's size. A coordinate keeps its least value, so the first rounds decide most bins, and two sets agree in a
coordinate with a probability equal to their Jaccard similarity, with Chernoff-like concentration.

Plan: texts -> one row of sketch and set digest per document; documents with equal sets (SHA-256 of the whole sorted
set) become one class; the classes' bands meet in buckets; each bucket is a star around its best connected member, so
a bucket of n gives n candidate pairs, not n^2. Stars are verified on the full sets. Stars alone may miss links
between two members that are both unlike the hub. Jaccard distance is a metric: with t = 1 - percent / 100, if v is
within 2t of the hub and v, w are linked, w is within 3t. So links of members within 2t are found among those within
3t, and what is beyond 2t of a bucket's hub meets the others beyond 2t in that bucket. In such a group only members
outside of its largest component so far are compared with all, in blocks, and only links that join two components
are returned (`_closure`), so a large group of copies costs no more than its size times its few strangers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.components import connected_components
from netloom.llm.store import drop, small_batches, table
from netloom.llm.textops import U, Words, chunks, int64, list_column, mix, shingle_sets


@dataclass(frozen=True)
class NearDedup:
    """words: shingle length. percent: link if 100 * intersection >= percent * union. bands of rows coordinates.

    The chance that two sets of the least linked similarity s share no band is (1 - s^rows)^bands: 4e-7 for
    s = 0.85 with 25 bands of 5, 5e-8 for s = 0.8 with 32 bands of 4. block and block_shingles bound what one task
    compares with each other: that many members and, on average, shingles on either side.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    block: int = 1500
    block_shingles: int = 1 << 21

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    def least_alike(self, share: float) -> float:
        """Sets of Jaccard similarity `share` agree in at least this share of coordinates but for less than 1 in 10^6
        cases (6 standard deviations). Such pairs are then verified on the full sets."""
        return max(0.0, share - 6 * (share * (1 - share) / self.bins) ** 0.5)


def fast_similarity_sketch(doc: np.ndarray, shingle: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """Sketches (docs x bins, uint64) of the sets given as (doc, shingle) rows; an empty set's row is all ones."""
    empty = ~U(0)
    sketch = np.full(docs * bins, empty, U)
    d, s = doc, shingle
    for i in range(2 * bins):
        h = mix(s ^ mix(np.array([i + 1], U)))
        at = (h >> U(32)) * U(bins) >> U(32) if i < bins else U(i - bins)
        np.minimum.at(sketch, d * bins + at.astype(np.int64), U(i << 48) | (mix(h) >> U(16)))
        open_ = (sketch.reshape(docs, bins) == empty).any(1)
        keep = open_[d]
        if not keep.all():
            d, s = d[keep], s[keep]
        if not len(d):
            break
    return sketch.reshape(docs, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + part[:, :, r])
    return key


def _sketches(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, end, offsets, data in chunks(batch):
                doc, shingle, size = shingle_sets(Words(offsets, data, lower=True), p.words)
                sketch = fast_similarity_sketch(doc, shingle, end - row, p.bins)
                edge = np.concatenate([[0], np.cumsum(size)])
                digest = [hashlib.sha256(shingle[a:b].tobytes()).digest() for a, b in zip(edge, edge[1:], strict=False)]
                full = size > 0
                keys = band_keys(sketch[full], p.bands, p.rows)
                low = (mix(sketch) >> U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, end - row), int64(size), pa.array(digest, pa.binary()),
                        list_column(keys.reshape(-1).view(np.int64), full * p.bands, pa.int64()),
                        pa.array([low[i].tobytes() if full[i] else b"" for i in range(end - row)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "keys", "sketch"],
                )

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted shingles of each text, read from the Arrow buffers: no Python string is made."""
    out: list[np.ndarray] = []
    for row, end, offsets, data in chunks(pa.RecordBatch.from_arrays([texts], ["text"])):
        _, shingle, size = shingle_sets(Words(offsets, data, lower=True), words)
        out += np.split(shingle, np.cumsum(size)[:-1])
    return out


def _verify(p: NearDedup):
    """(a, b, text_a, text_b), sorted by a -> (a, b, inter, total): sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for t in batches:
            hubs: list[np.ndarray] = []
            ids = t.column("a").to_numpy()
            fresh = np.ones(len(ids), bool)
            fresh[1:] = ids[1:] != ids[:-1]
            made = iter(_sets(t.column("text_a").filter(pa.array(fresh)), p.words))
            for a, new in zip(ids.tolist(), fresh.tolist(), strict=True):
                if new:
                    last = (a, next(made))
                hubs.append(last[1])
            own = _sets(t.column("text_b"), p.words)
            inter = np.array([_overlap(x, y) for x, y in zip(hubs, own, strict=True)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(hubs, own, strict=True)], np.int64) - inter
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(inter), pa.array(total)], ["a", "b", "inter", "total"])

    return run


class _Forest:
    def __init__(self, labels: list):
        self.root = {x: x for x in labels}

    def find(self, x):
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)
        return x != y


def _closure(p: NearDedup):
    """One task of a group -> links between members of different components.

    Rows: (kind, key, i, j, stranger, v, comp, text). Every stranger meets every other row; intersections come from an
    inverted list of the task's shingles. At most one link is returned for each merge.
    """

    def run(t: pa.Table) -> pa.Table:
        v, comp, stranger = (t.column(c).to_numpy() for c in ("v", "comp", "stranger"))
        place = np.lexsort((stranger, v))
        v, comp, stranger = v[place], comp[place], stranger[place]
        own = [x for texts in t.column("text").chunks for x in _sets(texts, p.words)]
        own = [own[i] for i in place]
        size = np.array([len(x) for x in own])
        # terms are the ranks of different shingles, posting[edge[x] : edge[x + 1]] the rows that hold term x
        flat = np.concatenate(own)
        del own
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.ones(len(flat), bool)
        first[1:] = flat[1:] != flat[:-1]
        del flat
        edge = np.append(np.flatnonzero(first), len(first))
        term = np.empty(len(order), np.int32)
        term[order] = np.cumsum(first, dtype=np.int32) - 1
        posting = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        del order, first
        start = np.concatenate([[0], np.cumsum(size)])
        forest = _Forest(comp.tolist())
        root = np.array([forest.find(c) for c in comp])
        found: list[tuple] = []
        for a in np.flatnonzero(stranger):
            if (root == root[a]).all():
                continue
            mine = term[start[a] : start[a + 1]]
            inter = np.bincount(np.concatenate([posting[edge[x] : edge[x + 1]] for x in mine]), minlength=len(size))
            linked = (100 * inter >= p.percent * (size + size[a] - inter)) & ~stranger & (root != root[a])
            for b in np.flatnonzero(linked):
                if forest.join(comp[a], comp[b]):
                    found.append((v[a], v[b]))
            if linked.any():
                root = np.array([forest.find(c) for c in comp])
        a, b = (pa.array([int(f[i]) for f in found], pa.int64()) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def _bytes_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of width bytes, and which are null (their bytes are 0)."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(x if x is not None else bytes(width) for x in column.to_pylist()), np.uint8).reshape(-1, width), null


def _alike(p: NearDedup, least: float):
    """Keeps candidate pairs whose sketches agree in a share of at least `least` of the coordinates; null agrees with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            (x, no_x), (y, no_y) = (_bytes_of(t.column(c), p.bins) for c in ("sketch_a", "sketch_b"))
            yield t.select(["a", "b"]).filter(pa.array(((x == y).mean(1) >= least) | no_x | no_y))

    return run


def _alike_members(p: NearDedup, least: float):
    """One task of a bucket's members that are unlike its hub -> those with an alike partner in another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, null = _bytes_of(pa.array(pdf.sketch.tolist(), pa.binary()), p.bins)
        comp, stranger = pdf.comp.to_numpy(), pdf.stranger.to_numpy()
        keep = np.zeros(len(pdf), bool)
        for a in np.flatnonzero(stranger):
            close = (((x == x[a]).mean(1) >= least) | null | null[a]) & ~stranger & (comp != comp[a])
            keep |= close
            keep[a] = close.any()
        return pdf.loc[keep, ["key", "i", "j", "stranger", "v", "comp"]]

    return run


def _tasks(spark: SparkSession, p: NearDedup, members: DataFrame) -> DataFrame:
    """members (key, v, comp, size) -> (key, i, j, stranger, v, comp, size): groups of more than one component.

    Strangers are the members outside of the group's largest component. Task (i, j) holds block i of the strangers and
    block j of all members, which the strangers are also part of: each stranger once for each block of members, each
    member once for each block of strangers.
    """
    members = table(spark, members, "members")
    by_comp = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    groups = by_comp.groupBy("key").agg(
        F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max(F.struct("n", -F.col("comp"), "s")).alias("top"),
        F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("s").alias("s"),
    ).where("comps > 1")
    blocks = lambda n, s: F.ceil(F.greatest(n / p.block, s / p.block_shingles)).cast("int")
    groups = groups.select("key", "main", blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("left"), blocks(F.col("n"), F.col("s")).alias("right"))
    groups = table(spark, groups, "groups")
    own = members.join(groups, "key")
    at = lambda n, seed: F.pmod(F.xxhash64("v", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strangers = own.where("comp <> main").withColumn("i", at("left", 1)).withColumn("j", every("right")).withColumn("stranger", F.lit(True))
    others = own.withColumn("j", at("right", 2)).withColumn("i", every("left")).withColumn("stranger", F.lit(False))
    out = table(spark, strangers.unionByName(others).select("key", "i", "j", "stranger", "v", "comp", "size"), "tasks")
    drop(members, groups)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, params: NearDedup = NearDedup()) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row for each row of docs.

    component_id is the smallest doc_id reachable over links, kept marks it. Texts are lower-cased in A-Z; words
    are runs without space or 0x09-0x0D; a text of fewer words than a shingle has one shingle. Null, empty and
    blank texts have an empty set and are linked with nothing. Rows that repeat a doc_id count
    as one document, which is linked if any of its texts is; each row is returned. Rows of a null doc_id are linked with
    nothing: their component_id is null, and they are kept. Texts are whole, however long. An empty table gives no rows;
    further columns are ignored. All tables but the result are deleted on the way.
    """
    p = params
    small_batches(spark)
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(table(spark, df, name))
        return made[-1]

    schema = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = keep(own.mapInArrow(_sketches(p), schema), "sketches")
    full = sk.where("n_shingles > 0")
    sets = keep(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "sets")
    member = keep(full.select("doc_id", "digest").join(sets, "digest").select("doc_id", "rep"), "member")
    reps = full.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id")
    one_sketch = F.when(F.min("sketch") == F.max("sketch"), F.max("sketch"))  # a repeated id may have several
    reps = keep(reps.agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), one_sketch.alias("sketch"), F.sum("n_shingles").alias("size")), "reps")

    in_band = reps.select(F.explode("keys").alias("k"), F.col("doc_id").alias("v"))
    shared = keep(in_band.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = keep(in_band.join(shared, "k"), "buckets")
    score = keep(buckets.groupBy("v").agg(F.sum("n").alias("score")), "score")
    hubs = buckets.join(score, "v").groupBy("k").agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("hub"))
    hubs = keep(hubs, "hubs")
    stars = keep(buckets.select("k", "v").join(hubs, "k"), "stars")
    edges = stars.where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()

    # one shuffle of texts; from here on only those that share a band with another
    texts = keep(own.join(score.withColumnRenamed("v", "doc_id"), "doc_id", "left_semi"), "texts")
    sketches = reps.select("doc_id", "sketch")
    t = 100 - p.percent
    both = edges.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    both = both.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    edges = keep(both.mapInArrow(_alike(p, p.least_alike((100 - 3 * t) / 100)), "a long, b long"), "star_edges")
    with_b = edges.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    links0 = both.sortWithinPartitions("a").mapInArrow(_verify(p), "a long, b long, inter long, total long")
    links0 = keep(links0, "star_links")
    linked = f"100 * inter >= {p.percent} * total"
    links = links0.where(linked).select("a", "b")
    comp = keep(connected_components(spark, links), "comp0")

    def labelled(df: DataFrame) -> DataFrame:
        out = df.join(comp.withColumnRenamed("node", "v"), "v", "left").withColumn("comp", F.coalesce("component", "v")).drop("component")
        return out.join(reps.select(F.col("doc_id").alias("v"), "size"), "v").select("key", "v", "comp", "size")

    near = links0.where(f"100 * inter >= {100 - 3 * t} * total").select(F.col("a").alias("key"), F.col("b").alias("v"))
    loose = links0.where(f"100 * inter >= {100 - 3 * t} * total and not ({linked})").select(F.col("a").alias("key")).distinct()
    near = near.join(loose, "key", "left_semi").distinct()
    near = near.unionByName(loose.select("key", F.col("key").alias("v")))
    near = _tasks(spark, p, labelled(near))
    covered = links0.where(f"100 * inter >= {100 - 2 * t} * total").select(F.col("a").alias("hub"), F.col("b").alias("v")).distinct()
    left = keep(stars.where("v <> hub").join(covered, ["hub", "v"], "left_anti").select(F.col("k").alias("key"), "v"), "left")
    several = keep(left.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "several")
    left = _tasks(spark, p, labelled(left.join(several, "key")))
    close = left.join(sketches.withColumnRenamed("doc_id", "v"), "v").groupBy("key", "i", "j")
    close = close.applyInPandas(_alike_members(p, p.least_alike(p.percent / 100)), "key long, i int, j int, stranger boolean, v long, comp long")
    tasks = near.drop("size").withColumn("kind", F.lit(0)).unionByName(close.withColumn("kind", F.lit(1)))
    more = keep(tasks.join(texts.withColumnRenamed("doc_id", "v"), "v").groupBy("kind", "key", "i", "j").applyInArrow(_closure(p), "a long, b long"), "more")
    comp = keep(connected_components(spark, links.unionByName(more)), "comp")

    by_doc = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    by_doc = by_doc.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sk.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = table(spark, out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near_duplicates")
    drop(near, left, *made)
    return out
