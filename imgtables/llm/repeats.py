"""Exact removal of repeated substrings by longest-previous-factor arrays over suffix order.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller
id. Suffixes of the whole corpus cannot be sorted in one place, so the work is cut to the places
that can match:

1. Texts are packed into shards of a few megabytes, stored bucketed by shard.
2. In every ``length``-byte window the k-grams with the smallest hash are anchors. Equal windows
   have equal anchors at the same offset, so a window can only repeat where its anchor does. Each
   shard sends each distinct anchor hash once; an anchor that meets another document is shared.
3. Around shared anchors, shards send the ``2 * length - k`` bytes of context, once per distinct
   context, with the smallest and largest document that has it. Per bucket of anchors, equal
   contexts fold. The remaining contexts are laid out in document order and their suffixes are
   sorted; from each suffix the previous and next entries with a smaller document, within the run
   of suffixes that agree on ``length`` bytes, tell whether the longest previous factor reaches
   ``length``, and the smallest document that has it.
4. Shards receive the answers and drop the covered bytes.

Windows, anchors, contexts and answers are judged on the input, bytes are compared with bytes, and
nothing is capped. What a hot passage sends is one entry per shard. An anchor that occurs in more
than ``hot_shards`` shards would gather its contexts in one bucket; its windows are sent one by one
instead and dealt out by their own hash.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..errors import ContractError
from ..session import checkpoint_root, materialize
from .batches import gathered

SHARD_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
NO_ID = (1 << 63) - 1  # a row without an id comes after all others
U = np.uint64
_FACTORS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(32)]  # odd multipliers, one per word
_NONE = np.uint32(0xFFFFFFFF)
_BLOCK = 1 << 16  # positions hashed at a time, so that the arrays stay in the processor's cache
SHARD_DDL = "shard long, n_bytes long, ids binary, sizes binary, payload binary"
ANSWER_DDL = "shard long, cids binary, firsts binary, lasts binary, sources binary, windows binary, window_sources binary"


@dataclass(frozen=True)
class Setting:
    length: int
    hot_shards: int

    @property
    def gram(self) -> int:
        return self.length * 12 // 25

    @property
    def flank(self) -> int:
        return self.length - self.gram

    @property
    def width(self) -> int:
        return 2 * self.length - self.gram


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width``, by doubling."""
    out, n = x, 1
    while 2 * n <= width:
        out, n = op(out[:-n], out[n:]), 2 * n
    return op(out[:len(x) - width + 1], out[width - n:width - n + len(x) - width + 1]) if n < width else out


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes at every position as a number; a view, nothing is copied."""
    return np.ndarray((max(len(data) - 7, 0),), kind, data.data if len(data) else b"", strides=(1,))


def _offsets(width: int) -> list[int]:
    """Word positions that cover ``width`` bytes."""
    return [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]


def _string_hash(words: np.ndarray, width: int, at: np.ndarray | slice | None = None) -> np.ndarray:
    """Hash of the ``width`` bytes at the given positions, or at every position.

    Words are mixed before they are added, so that differences of two words do not cancel out.
    """
    count = len(words) + 8 - width
    out, mixed = None, _mix(words) if at is None else None
    for i, o in enumerate(_offsets(width)):
        part = (mixed[o:o + count] if at is None else _mix(words[at + o])) * U(_FACTORS[i])
        out = part if out is None else np.add(out, part, out=out)
    return out


def _context_ids(s: Setting, words: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(_mix(_string_hash(words, s.width, start)) + left.astype(U) * U(256) + right.astype(U))


def _window_ids(s: Setting, words: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mix(_string_hash(words, s.length, start) ^ U(0xA5A5A5A5A5A5A5A5))


class Shard:
    """Texts laid out with gaps of ``length`` zero bytes, so that contexts never meet another text."""

    def __init__(self, setting: Setting, ids: bytes, sizes: bytes, payload: bytes):
        self.setting = setting
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        gap = setting.length
        self.starts = gap + np.r_[0, np.cumsum(self.sizes[:-1] + gap)].astype(np.int64)
        self.ends = self.starts + self.sizes
        self.data = np.zeros(int(self.ends[-1]) + gap if len(self.ids) else 2 * gap, np.uint8)
        raw, at = np.frombuffer(payload, np.uint8), 0
        for start, size in zip(self.starts.tolist(), self.sizes.tolist()):
            self.data[start:start + size] = raw[at:at + size]
            at += size

    def anchors(self) -> None:
        """Positions, hashes, owning texts and usable flanks of all anchors."""
        s = self.setting
        words = _words(self.data)
        count = len(self.data) - s.gram + 1
        usable = np.zeros(count + 1, np.int8)
        fit = self.sizes >= s.length
        np.add.at(usable, self.starts[fit], 1)
        np.add.at(usable, self.ends[fit] - s.gram + 1, -1)
        usable = np.cumsum(usable[:-1], dtype=np.int8).astype(bool)
        found = []
        for start in range(0, count, _BLOCK):
            low, high = max(0, start - s.flank), min(count, start + _BLOCK + s.flank)
            # 32 bits order the grams of a window; more ties only mean more anchors
            order = (_string_hash(words[low:high + s.gram - 8], s.gram) >> U(32)).astype(np.uint32)
            np.minimum(order, _NONE - np.uint32(1), out=order)
            order[~usable[low:high]] = _NONE
            edge = np.zeros(s.flank, np.uint32)
            if len(order) > s.flank:
                lowest = _slide(order, s.flank + 1, np.minimum)  # of the window that starts here
                reached = _slide(np.concatenate([edge, lowest, edge]), s.flank + 1, np.maximum)
                # ties are all anchors, so equal windows share one at the same offset
                at = np.flatnonzero((order == reached) & usable[low:high]) + low
                found.append(at[(at >= start) & (at < start + _BLOCK)])
        self.at = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.keys = _mix(_string_hash(words, s.gram, self.at))
        self.owner = np.searchsorted(self.ends, self.at, "right")
        self.docs = self.ids[self.owner] if len(self.at) else np.zeros(0, np.int64)
        self.left = np.minimum(s.flank, self.at - self.starts[self.owner]) if len(self.at) else self.at
        self.right = np.minimum(s.flank, self.ends[self.owner] - s.gram - self.at) if len(self.at) else self.at

    def context_ids(self, pick: np.ndarray) -> np.ndarray:
        """A hash of the picked anchors' contexts and flanks; contexts under one hash are compared by bytes when sent."""
        s = self.setting
        return _context_ids(s, _words(self.data), self.at[pick] - s.flank, self.left[pick], self.right[pick])

    def window_ids(self, spots: np.ndarray) -> np.ndarray:
        """A hash of the windows at the given positions."""
        return _window_ids(self.setting, _words(self.data), spots)

    def same_bytes(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Whether the ``width`` bytes at two positions are equal, for each pair of positions."""
        words = _words(self.data)
        same = np.ones(len(a), bool)
        for o in _offsets(width):
            same &= words[a + o] == words[b + o]
        return same

    def bytes_at(self, positions: np.ndarray, width: int) -> np.ndarray:
        return self.data[positions[:, None] + np.arange(width)]


def _joined(values) -> bytes:
    return b"".join(values or ())


def _short(keys: np.ndarray) -> bytes:
    """48-bit hashes in six bytes each. Equality on 48 bits only nominates anchors; bytes decide."""
    return (keys >> U(16)).astype("<u4").tobytes() + keys.astype("<u2").tobytes()


def _long(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return (np.frombuffer(blob, "<u4", n).astype(U) << U(16)) | np.frombuffer(blob, "<u2", n, 4 * n)


def _longs(blobs) -> np.ndarray:
    """All hashes of some blobs, sorted."""
    return np.sort(np.concatenate([_long(b) for b in blobs])) if blobs else np.zeros(0, U)


def _isin(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _by(groups: np.ndarray, *columns: np.ndarray):
    """Slices of columns per distinct value of ``groups``."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(groups)]):
        yield groups[a].item(), [c[order[a:b]] for c in columns]


# --- step 1 -----------------------------------------------------------------------------------

def _pack(docs: DataFrame, buckets: int) -> DataFrame:
    """The shard table, bucketed by shard in the checkpoint folder: later joins do not move texts."""
    spark = docs.sparkSession

    def run(batches):
        count = 0
        for table in gathered(batches, "text", SHARD_BYTES):
            texts = [v or b"" for v in table.column("text").combine_chunks().cast(pa.binary()).to_pylist()]
            ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() * (1 << 32) + count]), pa.array([int(sizes.sum())]), pa.array([ids.tobytes()]),
                 pa.array([sizes.tobytes()]), pa.array([b"".join(texts)])],
                names=["shard", "n_bytes", "ids", "sizes", "payload"],
            )
            count += 1

    name = f"imgtables_shards_{uuid.uuid4().hex}"
    packed = docs.mapInArrow(run, SHARD_DDL)
    packed.write.bucketBy(buckets, "shard").option("path", f"{checkpoint_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


# --- step 2 -----------------------------------------------------------------------------------

def _shared_anchors(shards: DataFrame, setting: Setting, buckets: int) -> DataFrame:
    """``(shard, shared, hot)``: per shard and bucket the anchor hashes that other shards have too."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(setting, row["ids"], row["sizes"], row["payload"])
                shard.anchors()
                keys = np.sort(shard.keys >> U(16))
                keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
                out = [(bucket, row["shard"], _short(part[0])) for bucket, part in _by((keys % U(buckets)).astype(np.int64), keys)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "shard", "keys"]
                    )

    def meet(table: pa.Table) -> pa.Table:
        blobs = table["keys"].to_pylist()
        keys = np.concatenate([_long(b) for b in blobs])
        owner = np.repeat(np.asarray(table["shard"]), [len(b) // 6 for b in blobs])
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[head, len(keys)])
        times = np.repeat(count, count)
        many = times > 1
        out = []
        for shard, (mine, n) in _by(owner[many], keys[many], times[many]):
            hot = n > setting.hot_shards
            out.append((shard, _short(mine[~hot]), _short(mine[hot])))
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["shard", "shared", "hot"])

    sent = shards.select("shard", "ids", "sizes", "payload").mapInArrow(send, "bucket long, shard long, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "shard long, shared binary, hot binary")


# --- step 3 -----------------------------------------------------------------------------------

def _fold(ids: np.ndarray, docs: np.ndarray, *same: np.ndarray):
    """First row, smallest and largest document per class: a run of rows that agree on id and on ``same``.

    Where ids collide, a class may come in several runs; each is sent.
    """
    if not len(ids):
        return np.zeros(0, np.int64), docs, docs
    order = np.argsort(ids, kind="stable")
    new = ids[order][1:] != ids[order][:-1]
    for values in same:
        differs = values[order][1:] != values[order][:-1]
        new |= differs.any(axis=1) if differs.ndim > 1 else differs
    head = np.flatnonzero(np.r_[True, new])
    return order[head], np.minimum.reduceat(docs[order], head), np.maximum.reduceat(docs[order], head)


def _contexts(shard: Shard, shared: np.ndarray, hot: np.ndarray):
    """What a shard sends: (bucket key, place, kind, left, right, smallest, largest, bytes) arrays.

    The place, where the bytes start in the shard, names a context in the answers.
    """
    s = shard.setting
    order = np.argsort(shard.keys)
    keys, docs = shard.keys[order], shard.docs[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    twice = keys[head][np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)] if len(keys) else keys
    is_hot = _isin(shard.keys >> U(16), hot)
    listed = _isin(shard.keys >> U(16), shared) | (_isin(shard.keys, twice) & ~is_hot)
    pick = np.flatnonzero(listed & (shard.left + s.gram + shard.right >= s.length))
    ids = shard.context_ids(pick)
    found = shard.bytes_at(shard.at[pick] - s.flank, s.width)
    sides = shard.left[pick] * 256 + shard.right[pick]
    first, low, high = _fold(ids, shard.docs[pick], found, sides, shard.keys[pick])
    out = [shard.keys[pick][first], (shard.at[pick][first] - s.flank).astype(U), np.zeros(len(first), np.uint8), shard.left[pick][first].astype(np.uint8),
           shard.right[pick][first].astype(np.uint8), low, high, found[first]]
    if is_hot.any():
        # each window around a hot anchor, as a context without a right flank
        spots = [np.arange(a - l, a - s.flank + r + 1) for a, l, r in
                 zip(shard.at[is_hot].tolist(), shard.left[is_hot].tolist(), shard.right[is_hot].tolist())]
        spots = np.unique(np.concatenate(spots))
        ids = shard.window_ids(spots)
        owner = np.searchsorted(shard.ends, spots, "right")
        found = np.zeros((len(spots), s.width), np.uint8)
        found[:, :s.length] = shard.bytes_at(spots, s.length)
        first, low, high = _fold(ids, shard.ids[owner], found)
        n = len(first)
        more = [ids[first], spots[first].astype(U), np.ones(n, np.uint8), np.full(n, s.flank, np.uint8), np.zeros(n, np.uint8), low, high, found[first]]
        out = [np.concatenate([a, b]) for a, b in zip(out, more)]
    return out


def suffix_sources(contexts: np.ndarray, rows: np.ndarray, columns: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Per suffix the smallest document that has its first ``length`` bytes.

    Suffix ``i`` starts in ``contexts[rows[i]]`` at ``columns[i]``; suffixes are given in document
    order. They are sorted by their first ``length`` bytes; the sort is stable, so within a run of
    equal suffixes documents ascend and the previous smaller entry is met walking back to the
    head of the run. Where the longest previous factor falls short, the source is the own document.
    """
    flat = np.r_[contexts.ravel(), np.zeros(8, np.uint8)]
    start = rows * contexts.shape[1] + columns
    own = docs[rows]
    # Suffixes that no other one equals by hash have no previous factor of this length.
    hashes = _mix(_string_hash(_words(flat), length, start))
    order = np.argsort(hashes)
    again = hashes[order][1:] == hashes[order][:-1]
    paired = np.zeros(len(start), bool)
    paired[order[1:][again]] = True
    paired[order[:-1][again]] = True
    rest = np.flatnonzero(paired)
    sources = own.copy()
    start, own = start[rest], own[rest]
    view = _words(flat, ">u8")  # big-endian words compare like the bytes
    words = [view[start + o].astype(U) for o in _offsets(length)]
    order = np.lexsort(words[::-1])
    longer = np.zeros(max(len(order) - 1, 0), bool)  # neighbours in suffix order that differ within length
    for w in words:
        longer |= w[order][1:] != w[order][:-1]
    head = np.flatnonzero(np.r_[True, longer]) if len(order) else np.zeros(0, np.int64)
    if len(order):
        smallest = np.minimum.reduceat(own[order], head)
        sources[rest[order]] = np.repeat(smallest, np.diff(np.r_[head, len(order)]))
    return sources


def _previous_factors(shards: DataFrame, shared: DataFrame, setting: Setting, buckets: int) -> DataFrame:
    """Answers per shard and bucket: context or window places, start offsets, and the smallest document."""
    width, flank, length = setting.width, setting.flank, setting.length
    kinds = ((U, 1), (np.uint8, 1), (np.uint8, 1), (np.uint8, 1), (np.int64, 1), (np.int64, 1), (np.uint8, width))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(setting, row["ids"], row["sizes"], row["payload"])
                shard.anchors()
                columns = _contexts(shard, _longs(row["shared"]), _longs(row["hot"]))
                pack = zstandard.ZstdCompressor(level=1).compress
                out = [(b, row["shard"], len(part[0]), pack(b"".join(p.tobytes() for p in part)))
                       for b, part in _by((columns[0] % U(buckets)).astype(np.int64), *columns[1:])]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "shard", "n", "packed"])

    def answer(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        unpack = zstandard.ZstdDecompressor().decompress
        for n, blob in zip(table["n"].to_pylist(), table["packed"].to_pylist()):
            raw, at = unpack(blob), 0
            for part, (kind, items) in zip(parts, kinds):
                part.append(np.frombuffer(raw, kind, n * items, at))
                at += part[-1].nbytes
        cid, kind, left, right, low, high, found = map(np.concatenate, parts)
        owner = np.repeat(np.asarray(table["shard"]), np.asarray(table["n"]))
        words, at = _words(found), np.arange(len(cid)) * width
        ident = np.where(kind == 0, _context_ids(setting, words, at, left, right), _window_ids(setting, words, at))
        # as sent: a context belongs to its anchor, a single window to itself
        key = np.where(kind == 0, _mix(_string_hash(words, setting.gram, at + flank)), ident)
        found = found.reshape(-1, width)
        # equal contexts are one class; the smallest document of a class stands for it
        order = np.lexsort((ident, kind, key))
        key, ident, cid, kind, left, right, low, high, found, owner = (
            x[order] for x in (key, ident, cid, kind, left, right, low, high, found, owner)
        )
        same_key = (key[1:] == key[:-1]) & (kind[1:] == kind[:-1])
        same = same_key & (ident[1:] == ident[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])
        same &= (found[1:] == found[:-1]).all(axis=1)
        head = np.flatnonzero(np.r_[True, ~same])
        members = np.diff(np.r_[head, len(key)])
        class_low = np.minimum.reduceat(low, head)
        new_key = np.r_[True, ~same_key][head]
        classes_of_key = np.bincount(np.cumsum(new_key) - 1)
        alone = np.repeat(classes_of_key, classes_of_key) == 1
        # one class: every window of the context has the same smallest document
        first, last = (flank - left[head]).astype(np.int64), right[head].astype(np.int64)
        runs = [(np.flatnonzero(alone), first[alone], last[alone], class_low[alone])]
        several = np.flatnonzero(~alone)
        several = several[np.argsort(class_low[several], kind="stable")]  # document order
        if len(several):
            n = last[several] - first[several] + 1
            rows = np.repeat(np.arange(len(several)), n)
            columns = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + first[several][rows]
            source = suffix_sources(found[head[several]], rows, columns, class_low[several], length)
            cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (source[1:] != source[:-1])])
            end = np.r_[cut[1:], len(rows)] - 1
            runs.append((several[rows[cut]], columns[cut], columns[end], source[cut]))
        which, first, last, source = (np.concatenate(c) for c in zip(*runs))
        # every member of a class gets the class's runs that lie in a smaller document
        times = members[which]
        record = np.repeat(head[which], times) + np.arange(times.sum()) - np.repeat(np.r_[0, np.cumsum(times)[:-1]], times)
        first, last, source = (np.repeat(x, times) for x in (first, last, source))
        hits = source < high[record]
        record, first, last, source = record[hits], first[hits], last[hits], source[hits]
        out = []
        for shard, (c, w, a, b, m) in _by(owner[record], cid[record], kind[record], first.astype(np.uint8), last.astype(np.uint8), source):
            ctx, win = w == 0, w == 1
            out.append((shard, *[x.tobytes() for x in (c[ctx], a[ctx], b[ctx], m[ctx], c[win], m[win])]))
        return pa.table([pa.array([o[i] for o in out], pa.binary() if i else pa.int64()) for i in range(7)],
                        names=["shard", "cids", "firsts", "lasts", "sources", "windows", "window_sources"])

    lists = shared.groupBy("shard").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot"))
    joined = shards.select("shard", "ids", "sizes", "payload").join(lists, "shard", "left")
    return joined.mapInArrow(send, "bucket long, shard long, n long, packed binary").groupBy("bucket").applyInArrow(answer, ANSWER_DDL)


# --- step 4 -----------------------------------------------------------------------------------

def covered_bytes(shard: Shard, cids, firsts, lasts, sources, windows, window_sources) -> np.ndarray:
    """Which bytes of the layout lie in a window that a smaller document has.

    An answer for the bytes at one place holds wherever the shard has the same bytes.
    """
    s = shard.setting
    change = np.zeros(len(shard.data) + 1, np.int64)

    def mark(ids, at, docs, answers, places, width, source, low, high):
        order = np.argsort(answers)
        answers = answers[order]
        a, b = np.searchsorted(answers, ids, "left"), np.searchsorted(answers, ids, "right")
        n = b - a
        who = np.repeat(np.arange(len(ids)), n)
        which = order[np.repeat(a, n) + np.arange(len(who)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)] if len(who) else who
        good = source[which] < docs[who]
        who, which = who[good], which[good]
        good = shard.same_bytes(at[who], places[which], width)
        who, which = who[good], which[good]
        np.add.at(change, at[who] + low[which], 1)
        np.add.at(change, at[who] + high[which] + s.length, -1)

    if len(cids):
        shard.anchors()
        usable = np.flatnonzero(shard.left + s.gram + shard.right >= s.length)
        places = cids.astype(np.int64)
        named = np.searchsorted(shard.at, places + s.flank)  # anchors stand in order
        sides = shard.left * 256 + shard.right
        first, last = firsts.astype(np.int64), lasts.astype(np.int64)
        for one in np.unique(sides[named]).tolist():
            mine, theirs = usable[sides[usable] == one], np.flatnonzero(sides[named] == one)
            mark(shard.context_ids(mine), shard.at[mine] - s.flank, shard.docs[mine], shard.context_ids(named[theirs]), places[theirs], s.width,
                 sources[theirs], first[theirs], last[theirs])
    if len(windows):
        spots = np.concatenate([np.arange(a, b - s.length + 1) for a, b in zip(shard.starts.tolist(), shard.ends.tolist())])
        zero, places = np.zeros(len(windows), np.int64), windows.astype(np.int64)
        mark(shard.window_ids(spots), spots, shard.ids[np.searchsorted(shard.ends, spots, "right")], shard.window_ids(places), places, s.length,
             window_sources, zero, zero)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 50, hot_shards: int = 4096, keep_bytes: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept).

    ``spans`` are the removed byte ranges, end exclusive; ``kept`` with ``keep_bytes`` the bytes
    that remain (they need not be valid UTF-8). A null text is empty; texts shorter than
    ``length`` lose nothing. Only a smaller id counts as earlier: rows that share an id do not
    match each other, and a row without an id comes after all rows with one. An empty table gives an
    empty result. Other columns are not read.
    """
    if not 16 <= length <= 120:
        raise ContractError("match lengths from 16 to 120 bytes are supported")
    spark = docs.sparkSession
    setting = Setting(length, hot_shards)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = _pack(rows, partitions)
    total = shards.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions, math.ceil(total / BUCKET_BYTES))
    shared = _shared_anchors(shards, setting, buckets)
    answers = _previous_factors(shards, shared, setting, buckets)
    names = ("cids", "firsts", "lasts", "sources", "windows", "window_sources")
    lists = materialize(answers).groupBy("shard").agg(*[F.collect_list(n).alias(n) for n in names])
    kinds = (U, np.uint8, np.uint8, np.int64, U, np.int64)
    span_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def drop(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(setting, row["ids"], row["sizes"], row["payload"])
                gone = covered_bytes(shard, *[np.frombuffer(_joined(row[n]), k) for n, k in zip(names, kinds)])
                out = []
                for doc, start, end in zip(shard.ids.tolist(), shard.starts.tolist(), shard.ends.tolist()):
                    mask = gone[start:end]
                    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                    kept = shard.data[start:end][~mask].tobytes()
                    spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
                    out.append((None if doc == NO_ID else doc, end - start, int(mask.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span_kind, pa.binary()))]
                fields = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                n = len(fields) if keep_bytes else len(fields) - 1
                yield pa.RecordBatch.from_arrays(columns[:n], names=fields[:n])

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    joined = shards.select("shard", "ids", "sizes", "payload").join(lists, "shard", "left")
    return joined.mapInArrow(drop, ddl + (", kept binary" if keep_bytes else ""))
