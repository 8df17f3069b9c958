"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Both token sequences of a text cover the same bytes, so each is a rising list of byte ends, and
aligning them is merging the two lists. Diagonals of the merge matrix at equal distances are cut
by binary search, which splits the merge into independent pieces of equal work, wherever texts
and long tokens lie. A piece emits one overlap per distinct end: the two tokens that hold the
byte before it. Ends that both lists share close groups; a group that crosses pieces is put
together from its parts.

On a table: one pass encodes every text and writes ids as packed integers, block by block of
texts. Counts of id pairs are summed inside tasks before they are shuffled. For the counts that
each text needs, a block asks for its distinct pairs once; the answers meet the block's packed
ids by block number.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from ..errors import ContractError
from ..session import materialize
from .batches import gathered

PIECE = 1 << 16  # ends merged in one piece
BLOCK_BYTES = 1 << 20  # text of one block; a task needs some hundred times as much for a moment
_GAP = np.uint8(0)


# --- vocabularies -----------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level entries: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class TokenizerPair:
    """Files of A (a byte-level BPE in JSON, its ranks and its pre-token pattern) and of B (a sentencepiece model)."""

    a_json: str
    a_ranks: str
    pattern: str
    b_model: str


class _Codec:
    """Encoders of both sides and the bytes of every token; one per Python worker."""

    def __init__(self, a_json: bytes, a_ranks: bytes, pattern: str, b_model: bytes):
        alphabet = _byte_alphabet()
        entries = json.loads(a_json)
        special = {t["content"]: t["id"] for t in entries.get("added_tokens", ())}
        plain = {bytes(alphabet[c] for c in token): i for token, i in entries["model"]["vocab"].items() if token not in special}
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, a_ranks.splitlines())}
        self.a_special = Tokenizer.from_buffer(a_json)
        self.a_special.encode_special_tokens = True
        # With ranks equal to ids both libraries merge alike, and this one is six times as fast.
        self.a_fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks == plain else None
        self.a = [b""] * (max([*plain.values(), *special.values()]) + 1)
        for token, i in plain.items():
            self.a[i] = token
        for token, i in special.items():
            self.a[i] = token.encode()
        self.b_encoder = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b = []
        for i in range(self.b_encoder.get_piece_size()):
            piece = self.b_encoder.id_to_piece(i)
            self.b.append(bytes([int(piece[3:5], 16)]) if self.b_encoder.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(t) for t in self.a], np.int64)
        self.b_len = np.array([len(t) for t in self.b], np.int64)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none where either side does not spell the text with a blank before it."""
        spaced = " " + text
        try:
            raw = spaced.encode()
        except UnicodeEncodeError:  # a lone surrogate is no text
            return [], []
        if self.a_fast is not None:
            a = self.a_fast.encode_ordinary(spaced)
        else:
            a = self.a_special.encode(spaced, add_special_tokens=False).ids
        b = self.b_encoder.encode(text, num_threads=1)
        if b"".join(map(self.a.__getitem__, a)) != raw or b"".join(map(self.b.__getitem__, b)) != raw:
            return [], []
        return a, b


_CODECS: dict = {}


def _codec(shared) -> _Codec:
    key, *files = shared.value
    if key not in _CODECS:
        _CODECS[key] = _Codec(*files)
    return _CODECS[key]


def _share(spark: SparkSession, pair: TokenizerPair):
    """The tokenizer files as a broadcast: a few megabytes, whatever the tables hold."""
    raw = []
    for path in (pair.a_json, pair.a_ranks, pair.b_model):
        with open(path, "rb") as handle:
            raw.append(handle.read())
    key = hashlib.sha256(b"".join(raw) + pair.pattern.encode()).hexdigest()
    return spark.sparkContext.broadcast((key, raw[0], raw[1], pair.pattern, raw[2]))


# --- merge path -------------------------------------------------------------------------------


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of each list come before every cut of the merge into pieces of ``piece`` ends.

    All diagonals are searched at once. At a cut ``(i, j)`` every end before it is no larger than
    every end after it; an end that both lists hold may lie on either side of a cut.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, piece, dtype=np.int64), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        other = diagonal - middle - 1
        goes_on = np.zeros(len(diagonal), bool)
        goes_on[open_] = a[middle[open_]] <= b[other[open_]]
        low = np.where(open_ & goes_on, middle + 1, low)
        high = np.where(open_ & ~goes_on, middle, high)
    return low, diagonal - low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, closes)``: every pair of tokens that share a byte, in order, and whether both end with it.

    ``a`` and ``b`` are rising byte ends with the same last end. Each piece merges its own ends
    and closes what it can see; an end that a cut divides closes in the later piece.
    """
    cut_a, cut_b = diagonal_cuts(a, b, piece)
    found = []
    for i0, i1, j0, j1 in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:]):
        if i0 and j0 < j1 and a[i0 - 1] == b[j0]:
            i0 -= 1  # this end's twin is here: the earlier piece left it out
        own_a, own_b = a[i0:i1], b[j0:j1]
        if len(own_a) and j1 < len(b) and own_a[-1] == b[j1]:
            own_a = own_a[:-1]  # its twin begins the next piece
        ends = np.concatenate([own_a, own_b])
        ends.sort(kind="stable")
        fresh = np.r_[True, ends[1:] != ends[:-1]] if len(ends) else np.zeros(0, bool)
        twice = np.zeros(len(ends), bool)
        twice[:-1] = ~fresh[1:]
        ends, closes = ends[fresh], twice[fresh]
        found.append((i0 + np.searchsorted(own_a, ends), j0 + np.searchsorted(own_b, ends), closes))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(part) for part in zip(*found))


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal text of every number below ``size``, left-aligned bytes with room for a separator, and lengths."""
    text = [str(i).encode() for i in range(size)]
    width = max(map(len, text), default=1) + 1
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in text), np.uint8).reshape(-1, width).copy(), np.array([len(t) for t in text])


class Aligner:
    """Aligns blocks of texts given their ids."""

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray):
        self.a_len, self.b_len = a_len, b_len
        self.text, self.width = _digits(max(len(a_len), len(b_len)))

    def links(self, a_ids, b_ids):
        """Overlaps of a block whose texts are laid end to end, as positions and as codes of id pairs."""
        i, j, closes = overlaps(np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]))
        return i, j, closes, a_ids[i].astype(np.int64) * len(self.b_len) + b_ids[j]

    def rendered(self, a_ids, b_ids, i, j, closes, n_a, n_b) -> tuple[list[bytes], np.ndarray]:
        """Per text its groups as text, ``a,a|b;a|b,b``, and their number.

        A closing overlap ends a group. Where a group's parts come from two pieces they are
        neighbours in the overlaps, so the running number of closed groups joins them.
        """
        last_a, last_b = i[closes], j[closes]
        group_a = np.searchsorted(last_a, np.arange(len(a_ids)))
        group_b = np.searchsorted(last_b, np.arange(len(b_ids)))
        place_a = np.arange(len(a_ids)) + np.r_[0, last_b + 1][group_a]
        place_b = np.arange(len(b_ids)) + last_a[group_b] + 1
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[place_a], order[place_b] = a_ids, b_ids
        mark = np.full(len(order), ord(","), np.uint8)
        mark[place_a[last_a]] = ord("|")
        mark[place_b[last_b]] = ord(";")
        upto = np.cumsum(np.asarray(n_a) + np.asarray(n_b))
        mark[upto[upto > 0] - 1] = _GAP
        cells, size = self.text[order], self.width[order]
        cells[np.arange(len(order)), size] = mark
        shown = cells != _GAP
        raw = cells[shown].tobytes()
        ends = np.r_[0, np.cumsum(shown.sum(1))]
        cuts = np.r_[0, ends[upto]]
        closed = np.searchsorted(last_a, np.cumsum(n_a) - 1, "right")
        return [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])], np.diff(np.r_[0, closed])


# --- on tables --------------------------------------------------------------------------------


def _width(size: int):
    return np.uint16 if size <= 1 << 16 else np.uint32


def _packed(ids: list[list[int]], size: int) -> bytes:
    """Ids of a block as compressed integers of the least width."""
    raw = np.fromiter(chain.from_iterable(ids), _width(size), sum(map(len, ids))).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(packed: bytes, size: int, count: int) -> np.ndarray:
    if count == 0:
        return np.zeros(0, np.int64)
    raw = pa.decompress(packed, count * np.dtype(_width(size)).itemsize, codec="zstd")
    return np.frombuffer(raw, _width(size)).astype(np.int64)


_BLOCK = "block long, rows binary, a binary, b binary"
_ROW = np.dtype([("id", "<i8"), ("null", "?"), ("n_a", "<i8"), ("n_b", "<i8")])


def align_texts(docs: DataFrame, pair: TokenizerPair, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A encodes a blank and the text, B the text, which it begins with a blank itself; strings of
    special tokens are plain text. Texts that are null, empty or not spelt exactly by either side
    have no tokens: zeros, and '' for the digest. ``n_links`` counts pairs of token occurrences
    whose bytes overlap; the count of an id pair is the number of links over all rows that hold
    it. ``n_best`` counts links whose count is the highest that their B id has, ``count_sum`` adds
    the counts of all links. Rows with a null or repeated id are rows like others, and other
    columns of ``docs`` do not matter. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = _share(spark, pair)

    def encode(batches):
        codec = _codec(shared)
        block = TaskContext.get().partitionId() << 33
        for table in gathered(batches, "text", BLOCK_BYTES):
            raw = table.column("text").combine_chunks().cast(pa.binary()).to_pylist()
            found = [codec.encode(v.decode("utf-8", "replace")) if v else ([], []) for v in raw]
            rows = np.zeros(len(found), _ROW)
            ids = table.column("id").combine_chunks()
            rows["null"] = ids.is_null().to_numpy(zero_copy_only=False)
            rows["id"] = ids.fill_null(0).to_numpy()
            rows["n_a"], rows["n_b"] = [len(a) for a, _ in found], [len(b) for _, b in found]
            yield pa.RecordBatch.from_pydict(
                {"block": [block], "rows": [rows.tobytes()], "a": [_packed([a for a, _ in found], len(codec.a))],
                 "b": [_packed([b for _, b in found], len(codec.b))]},
                schema=pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("a", pa.binary()), ("b", pa.binary())]),
            )
            block += 1

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = materialize(source.mapInArrow(encode, _BLOCK))

    def opened(codec, row):
        rows = np.frombuffer(row["rows"], _ROW)
        return rows, _unpacked(row["a"], len(codec.a), int(rows["n_a"].sum())), _unpacked(row["b"], len(codec.b), int(rows["n_b"].sum()))

    def pairs(batches):
        codec = _codec(shared)
        aligner = Aligner(codec.a_len, codec.b_len)
        for batch in batches:
            for row in batch.to_pylist():
                _, a, b = opened(codec, row)
                code, count = np.unique(aligner.links(a, b)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), row["block"])), pa.array(code), pa.array(count.astype(np.int64))], names=["block", "code", "n"]
                )

    asked = materialize(blocks.mapInArrow(pairs, "block long, code long, n long"))
    n_b = len(sentencepiece.SentencePieceProcessor(model_file=pair.b_model))
    counts = asked.groupBy("code").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    # one row per token of B at most
    best = counts.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("n").alias("most"))
    rated = counts.join(F.broadcast(best), F.col("code") % n_b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("block", "code").join(rated, "code").select("block", "code", "n", "best")
    schema = f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        codec = _codec(shared)
        aligner = Aligner(codec.a_len, codec.b_len)
        order = np.argsort(right.column("code").to_numpy())
        known = right.column("code").to_numpy()[order]
        n, top = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        out = []
        for row in left.to_pylist():
            rows, a, b = opened(codec, row)
            i, j, closes, code = aligner.links(a, b)
            at = np.searchsorted(known, code)
            if len(code) and (len(known) == 0 or (known[np.minimum(at, len(known) - 1)] != code).any()):
                raise ContractError("a block's pairs lack their counts")
            texts, groups = aligner.rendered(a, b, i, j, closes, rows["n_a"], rows["n_b"])
            cuts = np.searchsorted(i, np.r_[0, np.cumsum(rows["n_a"])])
            total = [np.r_[0, np.cumsum(v)] for v in (top[at].astype(np.int64), n[at])]
            out.append(pa.Table.from_arrays(
                [pa.array(rows["id"], mask=rows["null"]), pa.array(rows["n_a"]), pa.array(rows["n_b"]), pa.array(groups.astype(np.int64)),
                 pa.array(np.diff(cuts)), *[pa.array(np.diff(t[cuts])) for t in total],
                 pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())],
                names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            ))
        return pa.concat_tables(out)  # answers come for blocks only, so there is one

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answered, schema)
