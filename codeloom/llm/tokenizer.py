"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: the vocabulary's ranks are serialised as a sentencepiece BPE model: each token's bytes become
printable characters, its score is the negative rank, the normaliser is the identity.  Texts are cut into
pre-tokens by the vocabulary's pattern, each distinct pre-token is encoded once per worker, and decoding is
the inverse mapping.  The model (about a megabyte, fixed) is broadcast; the text never leaves its split.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; lone
surrogates cannot occur in a text column; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's public pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary lies if neither a parameter nor the session's ``spark.codeloom.vocabulary`` says so.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pre-tokens a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Characters that are cut into pre-tokens at a time.
GROUP_CHARS = 4_000_000


def byte_characters() -> str:
    """256 printable characters, one per byte: itself where it is printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(free)) for b in range(256))


_BYTES = byte_characters()
_TO_CHAR = {i: c for i, c in enumerate(_BYTES)}
_TO_BYTE = {ord(c): chr(i) for i, c in enumerate(_BYTES)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece numbers are the tokens' ranks; the last piece stands for unknown."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(_TO_CHAR).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, -float(len(tokens))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Texts to ids and back."""

    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; new pre-tokens of all texts go to the model at once."""
        split = [self.find(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = {p for parts in split for p in parts}.difference(known)
        if new:
            new = list(new)
            for p, ids in zip(new, self.pieces.encode([p.encode().decode("latin-1").translate(_TO_CHAR) for p in new], num_threads=1)):
                known[p] = struct.pack(f"<{len(ids)}i", *ids)
        get = known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text or ""])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        chars = "".join(self.pieces.id_to_piece(i) for i in ids)
        return chars.translate(_TO_BYTE).encode("latin-1").decode("utf-8")


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about ``GROUP_CHARS`` characters."""
    some, chars = [], 0
    for t in texts:
        some.append(t)
        chars += len(t)
        if chars > GROUP_CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


_ENCODERS: dict[str, Encoder] = {}


def _ranks(df: DataFrame, vocabulary: str | None) -> list[bytes]:
    return read_ranks(vocabulary or df.sparkSession.conf.get("spark.codeloom.vocabulary", VOCABULARY))


def encoded(docs: DataFrame, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(_ranks(docs, vocabulary)))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(shared.value, pattern)
        encode = _ENCODERS[name].encode_bytes
        for b in batches:
            texts, parts = b.column(1).to_pylist(), []
            for some in _by_size(["" if t is None else t for t in texts]):
                parts += encode(some)
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    shared = ids.sparkSession.sparkContext.broadcast(_ranks(ids, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for b in batches:
            texts = [b"".join(map(tokens.__getitem__, x)).decode("utf-8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Documents, characters and tokens per source."""
    sizes = encoded(docs, vocabulary).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))
    about = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    return about.join(sizes, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
