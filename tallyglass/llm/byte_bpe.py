"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The vocabulary (bytes -> rank) is serialised straight into the sentencepiece model format:
every byte becomes one private character, a token becomes the string of its bytes' characters,
its score is the negative rank, and normalisation is the identity. The greedy merge of
sentencepiece (highest score first, leftmost on ties) is then the merge by lowest rank.
Texts are split by a pre-token pattern first; no merge crosses a pre-token.

Defined results: null text encodes as the empty text (no ids); repeated rows are encoded each;
texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import free_name, opened, remember_only, remembers, sealed, small_batches, table

#: Rank file and pattern of the production query.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens a worker remembers before it starts anew.
CACHE = 200_000
#: A rank file above this size isn't sent to executors by broadcast.
MAX_MODEL_BYTES = 64 << 20

_BASE = 0x100
_TO_CHARS = {b: _BASE + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank table with ranks 0..n-1; piece ids equal ranks.

    Fields by number: ModelProto pieces=1, trainer_spec=2, normalizer_spec=3; piece=1, score=2,
    type=3 (2 is unknown); TrainerSpec model_type=3 (2 is BPE), vocab_size=4, unk_id=40,
    bos_id=41, eos_id=42, pad_id=43; NormalizerSpec name=1, add_dummy_prefix=3,
    remove_extra_whitespaces=4, escape_whitespaces=5.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0..n-1")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(_TO_CHARS).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    none = (1 << 64) - 1  # -1
    out += _field(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, none) + _number(42, none) + _number(43, none))
    out += _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class _Cache(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        n = self.pieces.get_piece_size() - 1
        self.whole = {self.pieces.id_to_piece(i): i for i in range(n)}
        self.token_bytes = [self.pieces.id_to_piece(i).translate({v: k for k, v in _TO_CHARS.items()}).encode("latin-1") for i in range(n)]

    def __missing__(self, token: str) -> bytes:
        chars = token.encode("utf-8").decode("latin-1").translate(_TO_CHARS)
        # a pre-token that is itself in the vocabulary is that token
        one = self.whole.get(chars)
        ids = [one] if one is not None else self.pieces.encode(chars)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(bytes(ids)).cast("I").tolist())) if ids else b""


_CACHES: dict[tuple[str, str], _Cache] = {}
remembers("byte_bpe", _CACHES.clear)


def _cache(model: bytes, pattern: str) -> _Cache:
    remember_only("byte_bpe")
    key = (hashlib.sha256(model).hexdigest(), pattern)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = _Cache(model, pattern)
    return _CACHES[key]


class ByteBpe:
    """Encoder and decoder over DataFrames. Ids are packed: 4 little-endian bytes for each."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        model = serialise_model(ranks)
        if len(model) > MAX_MODEL_BYTES:
            raise ValueError(f"a model of {len(model)} bytes is over {MAX_MODEL_BYTES}")
        self.spark, self.shared, self.pattern = spark, spark.sparkContext.broadcast(model), pattern

    def encode(self, text: Column) -> Column:
        """binary: the packed ids of each whole text."""
        shared, pattern = self.shared, self.pattern

        @F.pandas_udf("binary")
        def encode_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache = _cache(shared.value, pattern)
            for texts in batches:
                yield pd.Series([cache.encode(t) for t in texts], dtype=object)

        return encode_texts(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes that packed ids stand for (null: no bytes)."""
        shared, pattern = self.shared, self.pattern

        @F.pandas_udf("binary")
        def decode_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache = _cache(shared.value, pattern)
            for ids in batches:
                yield pd.Series([cache.decode(x) for x in ids], dtype=object)

        return decode_ids(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids: binary, decoded: binary>: packed ids of each whole text and what they decode to, by one worker."""
        shared, pattern = self.shared, self.pattern

        @F.pandas_udf("struct<ids: binary, decoded: binary>")
        def round_trips(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            cache = _cache(shared.value, pattern)
            for texts in batches:
                ids = [cache.encode(t) for t in texts]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([cache.decode(x) for x in ids], dtype=object)})

        return round_trips(text)


def unpacked(ids: Column) -> Column:
    """array<bigint> of packed ids, JVM side."""
    digits = F.hex(ids)
    at = F.sequence(F.lit(0), F.greatest(F.length(ids) / 4, F.lit(1)).cast("int") - 1)
    of = lambda i: F.concat(*[F.substring(digits, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
    return F.when(F.length(ids) > 0, F.transform(at, lambda i: F.conv(of(i), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed), ``n_tokens`` and ``decoded`` (bytes, equal to the text's UTF-8)."""
    small_batches(docs.sparkSession)
    bpe = ByteBpe(docs.sparkSession, ranks, pattern)
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]
    out = sealed(docs).select("_in", bpe.round_trip(F.col("_in").getField(text)).alias("_both"))
    ids = F.col("_both.ids")
    return opened(out, own, ids=ids, decoded=F.col("_both.decoded"), n_tokens=(F.length(ids) / 4).cast("long"))


def production_ranks(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and pre-token pattern; the path of the rank file is a parameter."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, *production_ranks())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their ids and the decoded text as text.

    The decoded text replaces the text, so what later readers see is what the ids stand for. ``ids``
    and ``n_tokens`` come last; where documents have columns of these names, ``_`` is put after the new ones.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_whole")
    out = encode_decode(docs.select("text", others), *production_ranks())
    own = [(F.decode("decoded", "UTF-8") if c == "text" else F.col("_whole").getField(c)).alias(c) for c in docs.columns]
    return out.select(*own, *[F.col(c).alias(free_name(c, docs.columns)) for c in ("ids", "n_tokens")])
