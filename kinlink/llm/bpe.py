"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Every byte is mapped to one printable character, every token of the vocabulary becomes a sentencepiece
BPE piece scored by its negative rank, and the normaliser is the identity. Pre-tokens of the split pattern
are encoded one by one; decoding maps ids back to pieces and pieces back to bytes.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, small_batches, tokenizer_path

#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 200_000


def byte_characters() -> list[str]:
    """For each byte its character: itself where printable in Latin-1, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: varint, length-delimited bytes or 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes last."""
    chars = byte_characters()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n-1")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be a token")
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))
    trainer += b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


#: The split pattern that has a faster equal for texts of code points below 256.
GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def latin_pattern() -> str:
    """GENERAL with its classes written out for Latin-1, from the Unicode categories."""
    import unicodedata

    def ranges(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)

    letter, number, space = ranges("L"), ranges("N"), r"\t-\r \x85\xa0"
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


class ByteBPE:
    """Encodes texts to the ids of a rank vocabulary and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        chars = byte_characters()
        self.split = regex.compile(pattern).findall
        self.split_latin = re.compile(latin_pattern()).findall if pattern == GENERAL else self.split
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.whole = {"".join(chars[b] for b in t): r for t, r in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.cache: dict[str, bytes] = {}  # pre-token to its ids as little-endian 32-bit integers

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def _learn(self, pieces: set[str]) -> None:
        rest, kept = [], []
        for piece in pieces:
            m = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
            if (one := self.whole.get(m)) is not None:
                self.cache[piece] = struct.pack("<i", one)
            else:
                rest.append(m)
                kept.append(piece)
        if rest:
            for piece, ids in zip(kept, self.model.encode(rest, out_type=int, num_threads=1)):
                self.cache[piece] = struct.pack(f"<{len(ids)}i", *ids)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none. Unknown pre-tokens of the batch are encoded in one call."""
        split = [self._split(t) if t else [] for t in texts]
        found = self.cache
        if unknown := set(itertools.chain.from_iterable(split)).difference(found):
            if len(found) + len(unknown) > CACHE_ENTRIES:
                found.clear()
                unknown = set(itertools.chain.from_iterable(split))
            self._learn(unknown)
        get = found.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), dtype="<i4") for pieces in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> ByteBPE:
    """One codec a process."""
    import public_tokenizers

    return ByteBPE(read_ranks(tokenizer_path(name, folder)), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary: the bytes that the ids decode to) of every text.

    Null and empty texts give no ids and empty bytes; repeated rows give repeated rows; an empty table
    gives none. Other columns of ``docs`` aren't read, whatever their names. No shuffle.
    """

    def make():
        bpe = codec(vocabulary, folder)

        def step(batch: pa.RecordBatch) -> dict:
            lists = bpe.encode_batch(batch.column(1).to_pylist())
            back = [bpe.decode(ids.tolist()) for ids in lists]
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))), "decoded": back}

        return step

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, ids array<int>, decoded binary", make)


def decode_ids(rows: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of rows of doc_id and ids; null ids decode to no bytes."""

    def make():
        bpe = codec(vocabulary, folder)
        return lambda batch: {"doc_id": batch.column(0), "decoded": [bpe.decode(x or []) for x in batch.column(1).to_pylist()]}

    return arrow_map(rows.select("doc_id", "ids"), "doc_id long, decoded binary", make)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text of documents, as counts and digests."""
    out = encode_documents(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
