"""Byte-level BPE with sentencepiece: the model is serialised from a rank file, nothing is trained.

Byte b stands as the character U+0100+b, so that no byte is a space or a control character. Piece number r has
score -r, so sentencepiece, which always merges the pair of the highest score and of equal ones the leftmost,
makes the merges of the rank file in their order. The normaliser is the identity. Text is split by the
vocabulary's pattern first and each pre-token is encoded by itself; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from netloom.llm.store import small_batches

_FROM_LATIN = {b: 0x100 + b for b in range(256)}
CACHE_PIECES = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a tiktoken file by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"ranks of {path} have gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_FROM_LATIN)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto in wire format: pieces by rank, one unknown piece after them."""
    # field numbers of sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3), trainer_spec 2 (model_type 3,
    # vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    # remove_extra_whitespaces 4, escape_whitespaces 5); model_type 2 is BPE, types 1 and 2 are normal and unknown
    pieces = [_field(1, _field(1, mapped(t).encode()) + _field(2, -float(r)) + _field(3, 1)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """encode(text) -> ids and decode(ids) -> bytes, with a bounded cache of pre-tokens."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.bytes_of = {str(i): t for i, t in enumerate(tokens)}
        self.cache: dict[str, str] = {}

    def encode_all(self, texts: list[str]) -> list[str]:
        """For each text its decimal ids joined by one space."""
        split = [self.find(t) for t in texts]
        new = list({p for s in split for p in s if p not in self.cache})
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {}
            new = list({p for s in split for p in s})
        ids = self.model.encode([mapped(p.encode()) for p in new], num_threads=1) if new else []
        self.cache.update((p, " ".join(map(str, x))) for p, x in zip(new, ids, strict=True))
        return [" ".join(map(self.cache.__getitem__, s)) for s in split]

    def encode(self, text: str) -> list[int]:
        ids = self.encode_all([text])[0]
        return [int(x) for x in ids.split(" ")] if ids else []

    def decode_ids(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_ids(" ".join(map(str, ids)))


_codecs: dict[str, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    tokens = shared.value
    key = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(model_bytes(tokens), tokens, pattern)
    return _codecs[key]


def tokenize(spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, ids, ids_sha256, decoded_sha256), one row for each row of docs.

    ids is the array of token ids (left out without with_ids). The digests are of the decimal ids joined by one
    space and of the bytes that decoding these ids gives. Null and empty texts have no tokens; rows are judged
    one by one, so ties, repeats and further columns change nothing. The vocabulary (a file of the driver) must be
    under 64 MB, as it is broadcast.
    """
    small_batches(spark)
    tokens = read_ranks(vocabulary)
    if sum(map(len, tokens)) > 64 << 20:
        raise ValueError("the vocabulary is too large to be broadcast")
    shared = spark.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            done: list[tuple] = []
            for text in texts:
                ids = codec.encode_all([text])[0]
                done.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(codec.decode_ids(ids)).hexdigest(), ids))
            n, a, b, ids_ = zip(*done, strict=True) if done else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([[int(x) for x in i.split(" ")] if i else [] for i in ids_], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
