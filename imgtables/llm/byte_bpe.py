"""Byte-level BPE encoding and decoding with a sentencepiece model built from a rank file.

Method: the model is serialised directly from the vocabulary. Byte ``b`` becomes the character
``U+0100 + b``, a piece is the string of its bytes' characters, its score is minus its rank, and
the normaliser is the identity, so sentencepiece merges in rank order over bytes. A text is cut
into the matches of a pattern, each match (pre-token) is encoded by itself, and a pre-token that
is a vocabulary entry is that entry. Decoding maps ids back to bytes through the inverse table.

The vocabulary is read by the driver and broadcast; its size is checked (``MAX_MODEL_BYTES``).
Texts stay in their partition, there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from ..errors import ContractError
from .batches import sliced

MAX_MODEL_BYTES = 64 << 20
CACHE_ENTRIES = 60_000  # pre-tokens remembered per Python worker; only speed depends on it
TEXT_BYTES = 1 << 20  # texts encoded together; a longer text is encoded by itself
FIRST_CHARACTER = 0x100


# --- the model file -------------------------------------------------------------------------

def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank on each line), by rank."""
    pieces = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                text, rank = line.split()
                pieces[int(rank)] = base64.b64decode(text)
    if sorted(pieces) != list(range(len(pieces))) or len(set(pieces.values())) != len(pieces):
        raise ContractError("ranks must run from 0 without gaps or repeats")
    vocabulary = [pieces[rank] for rank in range(len(pieces))]
    if not {bytes([b]) for b in range(256)} <= set(vocabulary):
        raise ContractError("a byte-level vocabulary needs all 256 single bytes")
    return vocabulary


def as_characters(raw: bytes) -> str:
    """One character per byte."""
    return (np.frombuffer(raw, np.uint8).astype("<u2") + FIRST_CHARACTER).tobytes().decode("utf-16-le")


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _nested(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model file in its protocol-buffer wire format.

    Field numbers of the public model format: piece 1 (string 1, score 2, type 3), trainer
    settings 2 (model type 3, vocabulary size 4), normaliser 3 (name 1, dummy prefix 3, remove
    spaces 4, escape spaces 5). Piece types: 1 normal, 2 unknown. Model type 2 is BPE.
    """
    normal, unknown, bpe = 1, 2, 2

    def piece(text: str, score: float, kind: int) -> bytes:
        return _nested(1, _nested(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    out = [piece(as_characters(raw), -float(rank), normal) for rank, raw in enumerate(vocabulary)]
    out.append(piece("<unk>", 0.0, unknown))
    out.append(_nested(2, _number(3, bpe) + _number(4, len(vocabulary) + 1)))
    out.append(_nested(3, _nested(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


# --- the codec ------------------------------------------------------------------------------

class BpeCodec:
    """Encodes texts to ids and ids to bytes; one per Python worker."""

    def __init__(self, vocabulary: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = vocabulary
        self.names = [str(i) for i in range(len(vocabulary))]
        self._rank = {raw: i for i, raw in enumerate(vocabulary)}
        self._split = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._known: dict[str, list[int]] = {}

    def _learn(self, tokens: list[str]) -> None:
        raws = [t.encode() for t in tokens]
        whole = [self._rank.get(raw) for raw in raws]
        rest = [i for i, rank in enumerate(whole) if rank is None]
        ends = np.cumsum([len(raws[i]) for i in rest]).tolist()
        mapped = as_characters(b"".join(raws[i] for i in rest))
        words = [mapped[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        merged = self._model.encode(words, out_type=int, num_threads=1) if words else []
        for token, rank in zip(tokens, whole):
            if rank is not None:
                self._known[token] = [rank]
        for i, ids in zip(rest, merged):
            self._known[tokens[i]] = ids

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the pre-tokens new to this worker are merged in one call."""
        split = [self._split(text) for text in texts]
        needed = set(chain.from_iterable(split))
        new = needed.difference(self._known)
        if len(self._known) + len(new) > CACHE_ENTRIES:
            self._known = {token: self._known[token] for token in needed.difference(new)}
        self._learn(list(new))
        for tokens in split:
            yield list(chain.from_iterable(map(self._known.__getitem__, tokens)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_CODECS: dict = {}  # lives as long as the Python worker, which serves many tasks


def _codec(shared) -> BpeCodec:
    key, vocabulary, model, pattern = shared.value
    if key not in _CODECS:
        _CODECS[key] = BpeCodec(vocabulary, model, pattern)
    return _CODECS[key]


def _broadcast(spark: SparkSession, vocabulary: list[bytes], pattern: str):
    model = serialise_model(vocabulary)
    if len(model) > MAX_MODEL_BYTES:
        raise ContractError(f"a vocabulary model of {len(model)} bytes is too large to broadcast")
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    return spark.sparkContext.broadcast((key, vocabulary, model, pattern))


# --- operators ------------------------------------------------------------------------------

COLUMNS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.BinaryType(), pa.binary()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode_texts(
    docs: DataFrame, vocabulary: list[bytes], pattern: str, *, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens"),
) -> DataFrame:
    """The rows of ``docs`` without ``text_col``, and the chosen output columns of ``COLUMNS``.

    ``ids``: token ids without special tokens; ``n_tokens``; ``ids_sha256``: digest of the ids
    in decimal joined by single spaces; ``decoded``: bytes that the ids decode to;
    ``decoded_sha256``: their digest. Null and empty texts have no ids. Bytes that are not
    UTF-8 count as U+FFFD. Other columns pass through; one that has the name of a chosen
    output gives way to it.
    """
    passed = [f for f in docs.schema.fields if f.name not in (*outputs, text_col)]
    schema = T.StructType([*passed, *[T.StructField(name, COLUMNS[name][0]) for name in outputs]])
    shared = _broadcast(docs.sparkSession, vocabulary, pattern)
    names = [f.name for f in passed]
    decodes = any(name.startswith("decoded") for name in outputs)

    def run(batches):
        codec = _codec(shared)
        for batch in sliced(batches, text_col, TEXT_BYTES):
            raw = batch.column(batch.schema.names.index(text_col)).cast(pa.binary())
            found: dict[str, list] = {name: [] for name in outputs}
            for ids in codec.encode([(v or b"").decode("utf-8", "replace") for v in raw.to_pylist()]):
                decoded = codec.decode(ids) if decodes else b""
                for name, values in found.items():
                    if name == "ids":
                        values.append(np.array(ids, np.int32))
                    elif name == "n_tokens":
                        values.append(len(ids))
                    elif name == "ids_sha256":
                        joined = " ".join(map(codec.names.__getitem__, ids))
                        values.append(hashlib.sha256(joined.encode()).hexdigest())
                    elif name == "decoded":
                        values.append(decoded)
                    else:
                        values.append(hashlib.sha256(decoded).hexdigest())
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(found[n], COLUMNS[n][1]) for n in outputs]], names=[*names, *outputs]
            )

    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)


def decode_ids(
    rows: DataFrame, vocabulary: list[bytes], *, ids_col: str = "ids", output: str = "decoded",
) -> DataFrame:
    """``rows`` with a binary column of what ``ids_col`` decodes to; null ids decode to nothing."""
    passed = [f for f in rows.schema.fields if f.name not in (output, ids_col)]
    shared = _broadcast(rows.sparkSession, vocabulary, "")
    names = [f.name for f in passed]

    def run(batches):
        pieces = shared.value[1]
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col)).to_pylist()
            decoded = [b"".join(map(pieces.__getitem__, row or ())) for row in ids]
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(decoded, pa.binary())], names=[*names, output])

    schema = T.StructType([*passed, T.StructField(output, T.BinaryType())])
    return rows.select(*[f"`{n}`" for n in names], f"`{ids_col}`").mapInArrow(run, schema)
