"""Encoding a corpus with a public byte-level BPE vocabulary.

A rank file (base64 of the token's bytes, then its rank) is turned into a serialised sentencepiece BPE model: every
token is written as a byte-mapped piece whose score is its negative rank, and the normaliser is the identity.
Texts are cut into pre-tokens, each is byte-mapped and encoded by the model; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Where the vocabulary files lie, unless a path is given.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the pattern that cuts a text into pre-tokens, as published with the vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by a worker, and the longest that is remembered.
MEMO, MEMO_CHARS = 100_000, 24
#: Pre-tokens given to the model at once.
BATCH = 20_000
#: Pieces before the first rank: sentencepiece wants one unknown piece.
OFFSET = 1


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


_BYTES = byte_alphabet()
_TO_BYTE = {c: b for b, c in enumerate(_BYTES)}
#: For str.translate after a Latin-1 decoding of UTF-8 bytes.
_MAP = {b: c for b, c in enumerate(_BYTES)}


def byte_map(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank; the ranks must be 0, 1, 2, ... without a gap."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens: list[bytes | None] = [None] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    if None in tokens:
        raise ValueError("ranks have gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes as length-delimited, float as 32 bits, int and bool as varint."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, (bool, int)):
        return _varint(number << 3) + _varint(int(value))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece ``OFFSET + rank`` is the byte-mapped token of that rank."""
    # Field numbers of sentencepiece_model.proto: ModelProto 1 pieces, 2 trainer, 3 normaliser;
    # SentencePiece 1 piece, 2 score, 3 type (1 normal, 2 unknown); TrainerSpec 3 model_type (2 BPE), 4 vocab_size,
    # 40 unk_id, 41 bos_id, 42 eos_id, 43 pad_id; NormalizerSpec 1 name, 3 add_dummy_prefix,
    # 4 remove_extra_whitespaces, 5 escape_whitespaces.
    absent = (1 << 64) - 1
    parts = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    parts += [_field(1, _field(1, byte_map(t).encode()) + _field(2, -float(rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(tokens) + OFFSET) + _field(40, 0) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(parts) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder over a serialised model. Encoding gives the vocabulary's ranks as ids, without special tokens."""

    def __init__(self, tokens: list[bytes]):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.cut = regex.compile(PRE_TOKEN).findall
        self.memo: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        cut, memo = self.cut, self.memo
        parts = [cut(t) if t else [] for t in texts]
        if len(memo) > MEMO:
            memo.clear()
        new = list({p for ps in parts for p in ps if p not in memo})
        long: dict[str, list[int]] = {}
        for i in range(0, len(new), BATCH):
            some = new[i : i + BATCH]
            mapped = [p.encode("utf-8").decode("latin-1").translate(_MAP) for p in some]
            for p, ids in zip(some, self.model.encode(mapped, num_threads=1)):
                (memo if len(p) <= MEMO_CHARS else long)[p] = [i - OFFSET for i in ids]
        out = []
        for ps in parts:
            ids: list[int] = []
            for p in ps:
                ids += memo[p] if p in memo else long[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        mapped = "".join(self.model.id_to_piece(int(i) + OFFSET) for i in ids)
        return bytes(_TO_BYTE[c] for c in mapped).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder a worker process and vocabulary."""
    return ByteBPE(read_ranks(path))


def encode_corpus(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of every row of ``docs``, repeated rows too.

    Null and empty texts give an empty list. vocabulary: path of a rank file that every executor can read.
    Texts are read whole; other columns are not read.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            ids = pa.array(bpe.encode_batch(batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` of encoded rows; a null list gives null, an empty one the empty text."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
