"""URL rules by a sorted digest array.

The rules' keys (host and path prefix) are hashed with 64-bit xxhash and sorted; digests, places and full strings lie one
after the other in one block that each Python worker maps into memory, without a file and without a Python object a rule. A url has a few possible keys: each suffix of its host at a dot, with each prefix
of its path that is as long as some rule's path. All possible keys of a batch are probed with one vectorised
binary search, and every hit is confirmed on the stored full string.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import small_batches

MAX_RULE_BYTES = 256 << 20


class DigestArray:
    """Sorted xxhash64 keys with the keys' full strings in one block of bytes, and verdicts beside them."""

    def __init__(self, rules: list[tuple[str, str, bool]]):
        """rules: (host, path prefix, allowed). Of equal keys the first counts."""
        keys: dict[str, bool] = {}
        for host, path, allowed in rules:
            keys.setdefault(f"{host}\n{path}", allowed)
        raw = [k.encode() for k in keys]
        digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        order = np.argsort(digest, kind="stable")
        self.digest = digest[order]
        self.offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in order], dtype=np.int64)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        self.allowed = np.array(list(keys.values()), bool)[order]
        self.lengths = sorted({len(path) for _, path, _ in rules})
        self.bytes = self.digest.nbytes + self.offsets.nbytes + self.blob.nbytes

    def mapped(self) -> DigestArray:
        """Puts digests, offsets and strings into one anonymous mapping of this worker, once."""
        if len(self.digest) and not hasattr(self, "block"):
            parts = (self.digest, self.offsets, self.blob)
            self.block, at = mmap.mmap(-1, sum(x.nbytes for x in parts)), 0
            for name, x in zip(("digest", "offsets", "blob"), parts, strict=True):
                self.block[at : at + x.nbytes] = x.tobytes()
                setattr(self, name, np.frombuffer(self.block, x.dtype, len(x), at))
                at += x.nbytes
        return self

    def key(self, i: int) -> str:
        return self.blob[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()

    def find(self, keys: list[str]) -> np.ndarray:
        """The rule's number for each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digest) or not keys:
            return out
        probe = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digest, probe)
        open_ = np.flatnonzero(at < len(self.digest))
        while len(open_):  # rules whose digests collide stand side by side
            open_ = open_[self.digest[at[open_]] == probe[open_]]
            same = np.array([self.key(at[i]) == keys[i] for i in open_], bool)
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.digest)]
        return out


def split_url(url="url"):
    """(host, path) columns: host between the first :// and the next / ? # or the end, lower-cased in A-Z."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def possible_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    if not host:
        return []
    labels = host.split(".")
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [f"{'.'.join(labels[i:])}\n{p}" for i in range(len(labels)) for p in prefixes]


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, bool]], default: str = "allow") -> DataFrame:
    """pages (page_id, url) -> (page_id, host, path, rule, verdict), one row for each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path
    together) wins, and of equally long ones the longer host. Without a rule the verdict is `default`. Null urls
    and urls without :// have empty host and path and no rule. Rows are judged one by one, so repeats and further
    columns change nothing. The rules are broadcast if they are under MAX_RULE_BYTES, else joined by their keys.
    """
    small_batches(spark)
    array = DigestArray(rules)
    host, path = split_url()
    own = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if array.bytes > MAX_RULE_BYTES:
        return _judge_by_join(spark, own, rules, array.lengths, default)
    shared = spark.sparkContext.broadcast(array)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value.mapped()
        for pdf in frames:
            keys = [possible_keys(h, p, table.lengths) for h, p in zip(pdf.host, pdf.path, strict=True)]
            hit = table.find([k for own_keys in keys for k in own_keys])
            rule, verdict, i = [], [], 0
            for own_keys in keys:
                n = len(own_keys)
                found = [x for x in hit[i : i + n] if x >= 0]
                i += n
                named = [(table.key(x), x) for x in found]
                best = max(named, key=lambda k: (len(k[0]), k[0].index("\n")), default=None)
                rule.append(None if best is None else best[0].replace("\n", ""))
                verdict.append(default if best is None else "allow" if table.allowed[best[1]] else "block")
            yield pdf.assign(rule=pd.Series(rule, dtype=object, index=pdf.index), verdict=verdict)

    kind = dict(pages.dtypes)["page_id"]
    return own.mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(spark: SparkSession, own: DataFrame, rules: list, lengths: list[int], default: str) -> DataFrame:
    """The same for rules too large to be broadcast: a join on the digest, confirmed on the strings."""
    table = spark.createDataFrame([(h, p, "allow" if a else "block") for h, p, a in rules], "rule_host string, rule_path string, said string")
    table = table.dropDuplicates(["rule_host", "rule_path"])
    distinct = own.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    keys = distinct.where("host <> ''").select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host")
    )
    keys = keys.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where(F.col("n") <= F.length("path"))
    keys = keys.withColumn("rule_path", F.expr("substring(path, 1, n)"))
    hits = keys.join(table, (F.xxhash64(keys.rule_host, keys.rule_path) == F.xxhash64(table.rule_host, table.rule_path)) & (keys.rule_host == table.rule_host) & (keys.rule_path == table.rule_path))
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat(table.rule_host, table.rule_path).alias("rule"), "said"), F.struct(F.length(table.rule_host) + F.length(table.rule_path), F.length(table.rule_host))).alias("best")
    )
    out = own.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))
