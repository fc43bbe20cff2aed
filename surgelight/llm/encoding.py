"""Encoding of a corpus with a public byte-level BPE vocabulary, by a sentencepiece model made from that vocabulary.

The vocabulary (ranks of byte strings) is serialised as a sentencepiece BPE model: piece i is the byte string of rank i
with every byte mapped to one visible character, its score is -i, normalisation is the identity. Merging the pair with
the best score is then merging the pair of lowest rank. Texts are cut into pre-tokens by the published pattern; every
distinct pre-token of a batch is encoded once. Piece ids are the vocabulary's ids; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.llm.batches import by_size
from surgelight.session import map_arrow, ship

# Fixed value: the pre-token pattern of the public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens longer than this are not kept for reuse.
KEEP_CHARS = 64
#: Reused pre-tokens; beyond it the store starts anew (nothing but time is lost).
KEEP_PRE_TOKENS = 200_000


def default_vocabulary() -> str:
    return os.environ.get("SURGELIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def byte_characters() -> list[str]:
    """One visible character for each byte: itself where it is printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [piece for _, piece in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(pieces: list[bytes]) -> bytes:
    """The sentencepiece model (protocol buffer) of a ranked byte vocabulary; the unknown piece comes last."""
    shown = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        out += _field(1, _field(1, "".join(shown[b] for b in piece).encode()) + _field(2, float(-rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, float(-len(pieces))) + _field(3, 2))
    bpe, unknown = 2, len(pieces)
    out += _field(2, _field(3, bpe) + _field(4, unknown + 1) + _field(40, unknown))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.pieces))
        self.cut = regex.compile(PATTERN)
        self.shown = byte_characters()
        self.table = {b: c for b, c in enumerate(self.shown)}
        self.known: dict[str, np.ndarray] = {}

    def _add(self, pre_tokens: list[str]) -> None:
        mapped = [t.encode("utf-8", "replace").decode("latin-1").translate(self.table) for t in pre_tokens]
        for token, ids in zip(pre_tokens, self.model.encode(mapped, num_threads=1)):
            self.known[token] = np.array(ids, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty text."""
        if len(self.known) > KEEP_PRE_TOKENS:
            self.known = {}
        cuts = [self.cut.findall(t) if t else [] for t in texts]
        new = list({t for tokens in cuts for t in tokens} - self.known.keys())
        if new:
            self._add(new)
        none, known = np.empty(0, np.int32), self.known
        out = [np.concatenate([known[t] for t in tokens]) if tokens else none for tokens in cuts]
        for t in new:
            if len(t) > KEEP_CHARS:
                del known[t]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(``id_col``, ``ids`` array of int) for every row of ``df``; strings that look like special tokens are ordinary text.

    A null or an empty text has an empty list. Repeated rows and null ids each give their row. No shuffle.
    ``vocabulary`` is the path of the ranks, present on every machine.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for part in by_size(batches, 1, 4 << 20):
            keys = part.column(0)
            lists = code.encode(part.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["i", "ids"])

    lean = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("i", lean.schema["i"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_arrow(lean, run, schema).select(F.col("i").alias(id_col), "ids")


def decoded(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a column ``text`` decoded from ``ids_col``; null ids give a null text."""
    path = vocabulary or default_vocabulary()
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def decode(ids):  # noqa: ANN001, ANN202
        code = encoder(path)
        return ids.map(lambda x: None if x is None else code.decode(x))

    return df.withColumn("text", decode(F.col(ids_col)))
