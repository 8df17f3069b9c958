"""Prefix trie of conversations in balanced parentheses, one sequence per shard.

Turns are identified by SHA-256 of role and text; the identity of a prefix is a digest over a
tree of its turns, 64 at a time, so that a conversation of any length is hashed by many tasks.
Grouping prefixes gives the nodes with their members. Nodes on one path with the same members
form an edge, named by smallest member and number of members; a conversation then is a short
list of edges, at most in the order of the root of all turns.

Different conversations, sorted by their edges, are dealt to shards by range. A shard writes its
part of the trie as a sequence of parentheses with blocks of smallest excess (a range min-max
tree): ``find_close`` delimits every subtree, the rank of ``()`` counts its leaves, and a
cumulative array over opening parentheses adds its savings. An edge on a shard's first or last
path can go on in a neighbouring shard; these shared spines are merged by adding their parts,
each of which counts an edge's own saving and its children only where its smallest member lies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

FAN = 64  # turns hashed together
BLOCK = 64  # parentheses in a leaf of the range min-max tree
SHARD_EDGES = 1 << 18
PIECE_IDS = 8192


# --- parentheses ------------------------------------------------------------------------------


class Parentheses:
    """A balanced sequence with a tree of smallest excess over its blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = max(-(-len(bits) // block), 1)
        self.size = 1 << (blocks - 1).bit_length()
        padded = np.full(blocks * block, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.tree = np.full(2 * self.size, np.iinfo(np.int64).max)
        self.tree[self.size:self.size + blocks] = padded.reshape(blocks, block).min(1)
        for level in range(self.size.bit_length() - 2, -1, -1):
            low, high = 1 << level, 2 << level
            self.tree[low:high] = self.tree[2 * low:2 * high].reshape(-1, 2).min(1)
        self.leaves = np.r_[0, np.cumsum(bits & ~np.r_[bits[1:], True])] if len(bits) else np.zeros(1, np.int64)

    def _scan(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of its block whose excess is no more than ``target``, or -1."""
        found, open_ = np.full(len(start), -1), np.arange(len(start))
        place = start.copy()
        stop = np.minimum((start // self.block + 1) * self.block, len(self.excess))
        while len(open_):
            open_ = open_[place[open_] < stop[open_]]
            hit = self.excess[place[open_]] <= target[open_]
            found[open_[hit]] = place[open_[hit]]
            open_ = open_[~hit]
            place[open_] += 1
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess[at] - 1
        found = np.full(len(at), -1)
        inside = (at + 1) % self.block != 0
        found[inside] = self._scan(at[inside] + 1, target[inside])
        open_ = np.flatnonzero(found < 0)
        node, want = at[open_] // self.block + self.size, target[open_]
        climbing = np.arange(len(open_))
        while len(climbing):
            after = node[climbing] + 1
            node[climbing] = after // (after & -after)  # the widest node that begins right after
            climbing = climbing[self.tree[node[climbing]] > want[climbing]]
        while len(inner := np.flatnonzero(node < self.size)):
            left = 2 * node[inner]
            node[inner] = left + (self.tree[left] > want[inner])
        found[open_] = self._scan((node - self.size) * self.block, want)
        return found


def shard_edges(offsets, edges: dict[str, np.ndarray], rep, ends, digest, last_is_leaf: bool) -> dict[str, np.ndarray]:
    """Values of the edges of sorted paths, from the shard's parentheses.

    Path ``i`` is ``offsets[i]:offsets[i+1]`` of every column of ``edges``: depths ``a`` and ``z``
    of the edge's first and last node, names ``c`` and ``n``, own saving ``w`` and ``base``, the
    bytes before it. ``rep`` is the smallest conversation on the path, ``digest`` that of all of
    them. ``last_is_leaf``: no path of a later shard extends the last.
    """
    conv, n = edges["c"], edges["n"]
    length = np.diff(offsets)
    shared = np.zeros(len(length), np.int64)
    if len(length) > 1:
        both = np.minimum(length[1:], length[:-1])
        begin = np.cumsum(both) - both
        step = np.arange(both.sum()) - np.repeat(begin, both)
        one, two = np.repeat(offsets[:-2], both) + step, np.repeat(offsets[1:-1], both) + step
        differ = np.where((conv[one] == conv[two]) & (n[one] == n[two]), np.iinfo(np.int64).max, step)
        shared[1:] = np.minimum(np.minimum.reduceat(differ, begin), both)
    runs = np.empty(2 * len(length), np.int64)
    runs[0::2], runs[1::2] = length - shared, length - np.r_[shared[1:], 0]
    trie = Parentheses(np.repeat(np.tile([True, False], len(length)), runs))
    opened = np.arange(len(conv)) - np.repeat(offsets[:-1], length) >= np.repeat(shared, length)
    at = np.flatnonzero(trie.bits)
    close = trie.find_close(at)
    size = (close - at + 1) // 2
    leaves = trie.leaves.copy()
    if not last_is_leaf:
        leaves[np.flatnonzero(np.diff(leaves))[-1] + 1:] -= 1
    depth = trie.excess[at]
    span = len(trie.bits) + 1
    by_depth = np.sort(depth * span + at)

    def opened_at(level, place):
        """Index of the last edge opened at this depth up to ``place``."""
        return np.searchsorted(at, by_depth[np.searchsorted(by_depth, level * span + place, "right") - 1] % span)

    begin = (np.cumsum(runs) - runs)[0::2]
    which = np.repeat(np.arange(len(length)), length)
    level = np.arange(len(conv)) - offsets[:-1][which] + 1
    place = begin[which] + np.maximum(level - 1 - shared[which], -1)
    own = conv == rep[which]
    weight = np.zeros(len(at), np.int64)
    weight[opened_at(level[own], place[own])] = edges["w"][own]
    upto = np.r_[0, np.cumsum(weight)]
    order = np.arange(len(at))
    inner = depth > 1
    parent = np.full(len(at), -1)
    parent[inner] = opened_at(depth[inner] - 1, at[inner])
    child = own & (level > 1)
    kids = parent[opened_at(level[child], place[child])]
    closing = np.full(len(at), None, object)
    end = offsets[1:] - 1
    closing[opened_at(level[end], place[end])] = digest
    return {
        "conv_id": conv[opened], "n_convs": n[opened], **{k: edges[k][opened] for k in ("a", "z", "base")},
        "parent_conv_id": np.where(inner, conv[opened][parent], -1), "has_parent": inner,
        "n_leaves": leaves[close] - leaves[at], "saved": upto[order + size] - upto[order],
        "n_children": np.bincount(kids, minlength=len(at)).astype(np.int64), "ends_sha256": closing,
        "spine": (order < length[0]) | (close >= len(trie.bits) - length[-1]),
    }


_EDGE = (
    "conv_id long, n_convs long, a long, z long, base long, parent_conv_id long, n_leaves long, saved long, n_children long, "
    "ends_sha256 string, spine boolean"
)


def _shards(batches):
    """Task body: sorted paths in, values of their edges out, ``SHARD_EDGES`` edges at a time."""

    def encoded(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        path = table.column("path").combine_chunks()
        flat = path.flatten()
        edges = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("a", "c", "n", "z", "base", "w")}
        offsets = np.r_[0, np.cumsum(path.value_lengths().to_numpy(zero_copy_only=False))]
        ends, rep = table.column("ends").to_numpy(), table.column("rep").to_numpy()
        digest = np.array(table.column("ends_sha256").to_pylist(), object)
        found = shard_edges(offsets, edges, rep, ends, digest, bool(edges["n"][-1] == ends[-1]))
        none = ~found.pop("has_parent")
        return pa.RecordBatch.from_pydict({
            k: pa.array(v, mask=none) if k == "parent_conv_id" else pa.array(v, pa.string()) if k == "ends_sha256" else pa.array(v)
            for k, v in found.items()
        })

    held, edges = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            edges += len(batch.column(batch.schema.names.index("path")).flatten())
            if edges >= SHARD_EDGES:
                yield encoded(held)
                held, edges = [], 0
    if held:
        yield encoded(held)


# --- conversations to paths -------------------------------------------------------------------


def _numbered(batches):
    """Task body: sorted turns with their place among the conversation's turns of the same partition."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        c = batch.column(0).to_numpy()
        if len(c) == 0:
            continue
        first = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
        place = np.arange(1, len(c) + 1) - np.repeat(first, np.diff(np.r_[first, len(c)]))
        if c[0] == last:
            place[:first[1] if len(first) > 1 else len(c)] += count
        last, count = c[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(c), part, np.int64)), pa.array(place.astype(np.int64)), batch.column(1), batch.column(2)],
            names=["c", "part", "place", "d", "bytes"],
        )


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``c, pos, d, bytes``: turns by their place in the conversation, from 1, with digest and bytes of the text.

    Null turns come first, equal turns in the order of their digests. Rows are sorted by range,
    so a conversation of any length is shared among tasks; one row per range comes to the driver
    to carry the numbers on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("d"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("d")]
    ranged = materialize(
        turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "d", "bytes")
        .mapInArrow(_numbered, "c long, part long, place long, d string, bytes long")
    )
    ends = ranged.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "place")).alias("last")).orderBy("part").collect()
    carried, before = [], {}
    for r in ends:
        carried.append((r["part"], r["first"], before.get(r["first"], 0)))
        c = r["last"]["c"]
        before = {c: r["last"]["place"] + before.get(c, 0) if c == r["first"] else r["last"]["place"]}
    offsets = conversations.sparkSession.createDataFrame(carried, "part long, first long, before long")
    placed = ranged.join(F.broadcast(offsets), "part")
    return placed.select("c", (F.col("place") + F.when(F.col("c") == F.col("first"), F.col("before")).otherwise(0)).alias("pos"), "d", "bytes")


def regrouped(turns: DataFrame, groups: int = 5, modulus: int = 9) -> DataFrame:
    """Conversations rebuilt on shared beginnings, ``c, pos, length, d, bytes``; a row with ``pos`` 0 begins each.

    With ``h`` the CRC-32 of the decimal id modulo ``modulus``, conversation ``c`` takes the first
    ``h`` turns of ``c - c % groups`` and then its own turns after its first ``h``.
    """
    turn = F.struct("pos", "d", "bytes")
    sizes = turns.groupBy("c").agg(F.max("pos").alias("size"), F.collect_list(F.when(F.col("pos") < modulus, turn)).alias("starts"))
    convs = sizes.select(
        "c", "size", (F.crc32(F.col("c").cast("string").cast("binary")) % modulus).alias("h"), (F.col("c") - F.col("c") % groups).alias("b")
    )
    bases = sizes.select(F.col("c").alias("b"), F.col("size").alias("base"), "starts")
    head = F.least("h", F.coalesce("base", F.lit(0)))
    convs = materialize(
        convs.join(bases, "b", "left").withColumn("head", head)
        .withColumn("length", F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).drop("base", "size", "b")
    )
    root = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("d"), F.lit(0).cast("long").alias("bytes"))
    taken = F.filter(F.coalesce("starts", F.array().cast("array<struct<pos:bigint,d:string,bytes:bigint>>")), lambda t: t["pos"] <= F.col("h"))
    heads = convs.select("c", "length", F.inline(F.concat(F.array(root), taken)))
    tails = turns.filter(F.col("pos") > F.crc32(F.col("c").cast("string").cast("binary")) % modulus).join(convs.drop("starts"), "c")
    moved = (F.col("head") + F.col("pos") - F.col("h")).alias("pos")
    return heads.unionByName(tails.select("c", "length", moved, "d", "bytes"))


def prefixed(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` (with ``pos`` from 1 to ``depth`` at most) with digest ``p`` and bytes ``upto`` of the prefix that ends there."""
    block = F.floor((F.col("pos") - 1) / FAN)
    extra = [c for c in rows.columns if c not in ("c", "pos")]
    blocks = rows.groupBy("c", block.alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", *extra))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["d"]), "")
    if depth > FAN:
        blocks = materialize(blocks)
        total = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["bytes"])
        upper = blocks.filter(F.size("t") == FAN).select(
            "c", (F.col("k") + 1).alias("pos"), F.sha2(joined.cast("binary"), 256).alias("d"), total.alias("bytes")
        )
        chain = prefixed(upper, -(-depth // FAN)).select("c", F.col("pos").alias("k"), F.col("p").alias("chain"), F.col("upto").alias("base"))
        blocks = blocks.join(chain, ["c", "k"], "left")
    else:
        blocks = blocks.withColumn("chain", F.lit(None).cast("string")).withColumn("base", F.lit(None).cast("long"))
    chain = F.coalesce("chain", F.lit(""))
    found = F.transform(
        F.sequence(F.lit(1), F.size("t")),
        lambda j: F.struct(
            F.element_at("t", j).alias("x"),
            F.sha2(F.concat(chain, F.lit("/"), F.substring("all", F.lit(1), 64 * j)).cast("binary"), 256).alias("p"),
            (F.coalesce("base", F.lit(0)) + F.aggregate(F.slice("t", F.lit(1), j), F.lit(0).cast("long"), lambda s, x: s + x["bytes"])).alias("upto"),
        ),
    )
    return blocks.withColumn("all", joined).select("c", F.explode(found).alias("f")).select("c", "f.x.*", "f.p", "f.upto")


def _ends(ends: DataFrame) -> DataFrame:
    """``rep, ends, ends_sha256`` of each prefix ``p`` that conversations ``c`` end at: smallest id, number, digest of all.

    Ids are joined to pieces by tasks over ranges; only pieces of ``PIECE_IDS`` ids meet where a
    prefix's text is hashed, one after the other, as SHA-256 demands.
    """

    def pieces(batches):
        for batch in batches:
            names, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [i for i in range(len(c)) if i == 0 or names[i] != names[i - 1] or i % PIECE_IDS == 0] + [len(c)]
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _ in spans], pa.string()), pa.array([c[i] for i, _ in spans], pa.int64()),
                 pa.array([j - i for i, j in spans], pa.int64()), pa.array([",".join(map(str, c[i:j])) for i, j in spans], pa.string())],
                names=["p", "first", "n", "ids"],
            )

    def hashed(batches):
        name, rep, total, state = None, None, 0, None
        for batch in batches:
            done = []
            for p, first, n, ids in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if p == name:
                    state.update(b"," + ids.encode())
                    total += n
                    continue
                if name is not None:
                    done.append((rep, total, state.hexdigest()))
                name, rep, total, state = p, first, n, hashlib.sha256(ids.encode())
            yield described(done)
        if name is not None:
            yield described([(rep, total, state.hexdigest())])

    def described(done):
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["rep", "ends", "ends_sha256"])

    cut = ends.repartitionByRange("p", "c").sortWithinPartitions("p", "c").mapInArrow(pieces, "p string, first long, n long, ids string")
    return cut.repartition("p").sortWithinPartitions("p", "first").mapInArrow(hashed, "rep long, ends long, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------------------


def conversation_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``rows`` as :func:`regrouped` gives them.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without conversations there
    is no node at all.
    """
    rows = materialize(rows)
    depth = rows.agg(F.max("pos")).first()[0] or 0
    paths = rows.filter("pos = 0").withColumn("p", F.lit("")).withColumn("upto", F.lit(0).cast("long"))
    if depth:
        paths = paths.unionByName(prefixed(rows.filter("pos > 0"), depth))
    paths = materialize(paths)

    nodes = materialize(
        paths.groupBy("p").agg(
            F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pos").alias("depth"), F.min("bytes").alias("bytes"), F.min("upto").alias("upto")
        )
    )
    saving = (F.col("n_convs") - 1) * F.col("bytes")
    edges = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("a"), F.max("depth").alias("z"), F.sum(saving).alias("w"), F.min(F.col("upto") - F.col("bytes")).alias("base"),
        F.min_by("p", "depth").alias("p"),
    )
    edge = F.struct("a", F.col("conv_id").alias("c"), F.col("n_convs").alias("n"), "z", "base", "w")
    lists = paths.select("c", "p").join(edges.select("p", edge.alias("e")), "p").groupBy(F.col("c").alias("rep")).agg(
        F.array_sort(F.collect_list("e")).alias("path")
    )
    listed = _ends(paths.filter("pos = length").select("p", "c")).join(lists, "rep")
    parts = materialize(
        materialize(listed).select("path", "rep", "ends", "ends_sha256").repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_shards, _EDGE)
    )
    spines = parts.filter("spine").groupBy("conv_id", "n_convs").agg(
        *[F.min(c).alias(c) for c in ("a", "z", "base")], *[F.max(c).alias(c) for c in ("parent_conv_id", "ends_sha256")],
        *[F.sum(c).alias(c) for c in ("n_leaves", "saved", "n_children")],
    )
    merged = parts.filter("not spine").drop("spine").unionByName(spines)
    at_top, at_end = F.col("depth") == F.col("a"), F.col("depth") == F.col("z")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(merged, ["conv_id", "n_convs"]).select(
        "conv_id", "depth", F.when(at_top, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("upto") - F.col("bytes") - F.col("base"))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` rebuilt as :func:`regrouped` says.

    Null roles and texts count as empty; turns are ordered by number, null first, equal ones by
    the digest of their content; repeated rows are turns of their own. A row without ``conv_id``
    belongs to no conversation. Other columns do not matter; an empty table gives an empty trie.
    """
    return conversation_trie(regrouped(materialize(numbered_turns(conversations))))
