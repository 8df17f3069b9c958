"""Nearest neighbours by largest inner product with a forest of hash-prefix trees.

Method: vectors get one more coordinate that makes all lengths equal, so the largest inner
product is the smallest angle; each of ``trees`` trees hashes them to a string of ``BITS``
random-hyperplane bits and keeps the strings as sorted arrays. A query descends each array to
the entries that share its longest prefix and all trees ascend together, one bit shorter each
time, which adds the entries that share the shorter prefix. Everything within a prefix is one
range of a sorted array, so a level's candidates are found by binary search and scored by
matrix products in double precision on the original vectors.

How far to ascend is measured, not guessed: the true neighbours of at most ``sample`` queries
are found by a scan of all rows, and the ascent stops at the deepest level that finds
``recall`` of them. Queries that still lack neighbours ascend further, down to level zero,
which is every row. All rows are indexed.

The arrays are dealt out by tree and leading bits to pieces of about ``block_rows`` entries.
A prefix with more entries than that is cut into several pieces by a hash of the entry, and
queries visit each piece; crowds of queries are cut in the same way. Equal vectors are folded
to one entry that remembers its ``k + 1`` smallest ids, which is all that a top ``k`` can show.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

BITS = 32
SEED = 2026
SEARCH_DDL = "query long, candidate long, score double, bits int"


class Forest:
    """Hyperplanes and layout shared by all tasks; a few hundred kilobytes, whatever the table's size."""

    def __init__(self, dim: int, trees: int, top_norm: float):
        self.dim, self.trees, self.top_norm = dim, trees, top_norm
        self.planes = np.random.default_rng(SEED).normal(size=(dim + 1, trees * BITS))

    def hashes(self, vectors: np.ndarray, *, queries: bool) -> np.ndarray:
        """``(rows, trees)`` hash strings as unsigned numbers, first bit highest."""
        signs = vectors @ self.planes[:-1]
        if not queries:
            rest = np.sqrt(np.maximum(self.top_norm ** 2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
            signs += rest[:, None] * self.planes[-1]
        bits = np.packbits((signs > 0).reshape(len(vectors), self.trees, BITS), axis=2)
        return np.ascontiguousarray(bits).view(">u4")[:, :, 0].astype(np.uint64)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    differ = (a ^ b).astype(np.float64)
    return BITS - np.ceil(np.log2(differ + 1)).astype(np.int64)


def _mix(keys: np.ndarray) -> np.ndarray:
    """A hash of ids, to deal entries out evenly."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _near_best(scores: np.ndarray, keep: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all scores that come within ``margin`` of the row's ``keep``-th largest."""
    if scores.shape[1] <= keep:
        return tuple(i.ravel() for i in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    return np.nonzero(scores >= (least - margin)[:, None])


def _pairs(q_keys, q_vecs, keys, vecs, keep):
    """Best candidates of each query, ties to the smaller key: rows of (query position, candidate position, score).

    The matrix product only nominates; whatever its rounding could have put on the wrong side
    is scored again, and the exact score and the key decide.
    """
    reach = np.sqrt(np.einsum("ij,ij->i", vecs, vecs).max(initial=0.0))
    for start in range(0, len(q_keys), 256):
        block = q_vecs[start:start + 256]
        rows, cols = _near_best(block @ vecs.T, keep, 1e-12 * reach * np.sqrt(np.einsum("ij,ij->i", block, block)))
        cuts = range(0, len(rows), 1 << 16)
        exact = np.concatenate([np.einsum("ij,ij->i", block[rows[i:i + (1 << 16)]], vecs[cols[i:i + (1 << 16)]]) for i in cuts] or [np.zeros(0)])
        order = np.lexsort((keys[cols], -exact, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        kept = order[place < keep]
        yield rows[kept] + start, cols[kept], exact[kept]


def _fold(rows: DataFrame, k: int, is_query) -> tuple[DataFrame, DataFrame]:
    """``(entries(key, vec, is_query), members(key, vec_id, is_query, place))``; place counts ids up to k + 1."""
    entries = materialize(
        rows.groupBy("vec").agg(F.min("vec_id").alias("key"), F.max(is_query(F.col("vec_id"))).alias("is_query"))
    )
    ids = rows.join(entries.select("vec", "key"), "vec").select("key", "vec_id").distinct()
    first = Window.partitionBy("key").orderBy("vec_id")
    few = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    asked = ids.filter(is_query(F.col("vec_id")))
    return entries, few.unionByName(asked.withColumn("place", F.lit(None).cast("int")))


def _calibrated_level(entries: DataFrame, forest: Forest, *, k: int, sample: int, recall: float) -> int:
    """The deepest level whose candidates hold ``recall`` of the sample queries' true neighbours."""
    spark = entries.sparkSession
    order = F.xxhash64("key")
    chosen = [r[1] for r in entries.filter("is_query").select(order.alias("h"), "key").orderBy("h", "key").limit(sample).collect()]
    asked = entries.filter(F.col("key").isin(chosen)).limit(sample).select("key", "vec").collect()
    q_keys = np.array([r["key"] for r in asked], np.int64)
    q_vecs = np.array([r["vec"] for r in asked], np.float64).reshape(-1, forest.dim)
    shared = spark.sparkContext.broadcast((forest, q_keys, q_vecs, forest.hashes(q_vecs, queries=True)))

    def scan(batches):
        forest, q_keys, q_vecs, q_hashes = shared.value
        for batch in batches:
            if not batch.num_rows or not len(q_keys):
                continue
            keys, vecs = np.asarray(batch.column(0)), _vectors(batch.column(1), forest.dim)
            hashes = forest.hashes(vecs, queries=False)
            for rows, cols, scores in _pairs(q_keys, q_vecs, keys, vecs, k + 1):
                bits = _shared_bits(q_hashes[rows], hashes[cols]).max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_keys[rows]), pa.array(keys[cols]), pa.array(scores), pa.array(bits.astype(np.int32))],
                    names=["query", "candidate", "score", "bits"],
                )

    found = entries.select("key", "vec").mapInArrow(scan, SEARCH_DDL).filter("query <> candidate")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))
    true = found.withColumn("r", rank).filter(F.col("r") <= k).groupBy("bits").count().collect()
    counts = np.zeros(BITS + 1)
    for row in true:
        counts[row["bits"]] = row["count"]
    reached = np.cumsum(counts[::-1])[::-1] / max(counts.sum(), 1)  # share found at level b or deeper
    return max([level for level in range(BITS + 1) if reached[level] >= recall], default=0)


def _crowded(entries: DataFrame, forest: Forest, lead: int, block_rows: int) -> dict:
    """Pieces per side of prefixes that hold more than ``block_rows`` entries or queries.

    At most (entries x trees / block_rows) prefixes can be listed.
    """
    shared = entries.sparkSession.sparkContext.broadcast(forest)

    def places(batches):
        for batch in batches:
            vecs, asked = _vectors(batch.column(0), shared.value.dim), np.asarray(batch.column(1).to_pylist(), bool)
            for side, some in ((0, vecs), (1, vecs[asked])):
                if len(some):
                    codes = _codes(shared.value.hashes(some, queries=bool(side)), lead)
                    code, count = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), side, np.int32)), pa.array(code), pa.array(count)], names=["side", "code", "n"]
                    )

    counted = entries.select("vec", "is_query").mapInArrow(places, "side int, code long, n long")
    big = counted.groupBy("side", "code").agg(F.sum("n").alias("n")).filter(F.col("n") > block_rows).collect()
    return {(r["side"], r["code"]): math.ceil(r["n"] / block_rows) for r in big}


def _codes(hashes: np.ndarray, lead: int) -> np.ndarray:
    """Tree and leading bits as one number, ``(rows, trees)`` flattened by row."""
    prefix = hashes >> np.uint64(BITS - lead) if lead else np.zeros_like(hashes)
    return (prefix.astype(np.int64) * hashes.shape[1] + np.arange(hashes.shape[1])).ravel()


def _search(entries: DataFrame, queries: DataFrame, forest: Forest, *, level: int, k: int, block_rows: int, total: int) -> DataFrame:
    """Per query and piece the best ``k + 1`` of the entries that share ``level`` leading bits."""
    lead = min(level, max(0, math.ceil(math.log2(max(total, 1) / block_rows))))
    pieces = _crowded(entries, forest, lead, block_rows)
    shared = entries.sparkSession.sparkContext.broadcast((forest, pieces))

    def deal(side: int):
        """Rows (code, piece, query piece, side, ids, hashes, vectors): one per destination and batch."""

        def run(batches):
            forest, pieces = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, vecs = np.asarray(batch.column(0)), _vectors(batch.column(1), forest.dim)
                hashes = forest.hashes(vecs, queries=bool(side))
                codes = _codes(hashes, lead)
                order = np.argsort(codes, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(order)]
                out = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    code, at = int(codes[order[a]]), order[a:b]
                    rows, tree = at // forest.trees, int(at[0] % forest.trees)
                    own, others = pieces.get((side, code), 1), pieces.get((1 - side, code), 1)
                    part = _mix(ids[rows]) % np.uint64(own)
                    for p in range(own):
                        r = rows[part == p] if own > 1 else rows
                        if not len(r):
                            continue
                        blob = ids[r].tobytes(), hashes[r, tree].tobytes(), vecs[r].tobytes()
                        for o in range(others):
                            out.append((code, *((o, p) if side else (p, o)), side, *blob))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)],
                    names=["code", "piece", "q_piece", "side", "ids", "hashes", "vecs"],
                )

        return run

    def score(table: pa.Table) -> pa.Table:
        forest, _ = shared.value
        sides = []
        for side in (0, 1):
            part = table.filter(pa.compute.equal(table["side"], side))
            join = [b"".join(part[c].to_pylist()) for c in ("ids", "hashes", "vecs")]
            hashes = np.frombuffer(join[1], np.uint64)
            order = np.argsort(hashes, kind="stable")  # the sorted array of this tree
            sides.append((np.frombuffer(join[0], np.int64)[order], hashes[order],
                          np.frombuffer(join[2], np.float64).reshape(-1, forest.dim)[order]))
        (keys, hashes, vecs), (q_keys, q_hashes, q_vecs) = sides
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int32)]]
        if len(keys) and len(q_keys):
            cut = np.uint64(BITS - level)
            prefix = q_hashes >> cut if level else np.zeros_like(q_hashes)
            heads = np.flatnonzero(np.r_[True, np.diff(prefix) != 0])
            for a, b in zip(heads, [*heads[1:], len(prefix)]):  # queries that share a prefix share its range
                low = np.searchsorted(hashes, prefix[a] << cut) if level else 0
                high = np.searchsorted(hashes, (prefix[a] << cut) | ((np.uint64(1) << cut) - np.uint64(1)), "right") if level else len(hashes)
                if low == high:
                    continue
                for rows, cols, scores in _pairs(q_keys[a:b], q_vecs[a:b], keys[low:high], vecs[low:high], k + 1):
                    out[0].append(q_keys[a:b][rows])
                    out[1].append(keys[low:high][cols])
                    out[2].append(scores)
                    out[3].append(_shared_bits(q_hashes[a:b][rows], hashes[low:high][cols]).astype(np.int32))
        return pa.table([np.concatenate(c) for c in out], names=["query", "candidate", "score", "bits"])

    ddl = "code long, piece int, q_piece int, side int, ids binary, hashes binary, vecs binary"
    dealt = entries.select("key", "vec").mapInArrow(deal(0), ddl).unionByName(
        queries.select("key", "vec").mapInArrow(deal(1), ddl)
    )
    return dealt.groupBy("code", "piece", "q_piece").applyInArrow(score, SEARCH_DDL)


def nearest_by_inner_product(
    table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
    trees: int = 24, recall: float = 0.94, sample: int = 256, block_rows: int = 8192,
) -> DataFrame:
    """``(query_id, rank, vec_id, score, bits)``: each query's ``k`` nearest found, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows.
    ``bits`` is the longest hash prefix that a tree shared with the query. Vectors that are
    null, zero or hold null or non-finite values, rows without an id, and vectors whose
    length is not the table's most frequent one take no part. Repeated rows count once. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = table.sparkSession
    raw = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = raw.filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    common = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    result = "query_id long, rank int, vec_id long, score double, bits int"
    if common is None:
        return spark.createDataFrame([], result)
    dim = common["n"]
    rows = usable.filter(F.size("vec") == dim)

    entries, members = _fold(rows, k, lambda c: c % every == 0)
    members = materialize(members)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    total, top = entries.agg(F.count("*"), F.max(F.sqrt(squares))).first()
    forest = Forest(dim, trees, top)
    level = _calibrated_level(entries, forest, k=k, sample=sample, recall=recall)
    queries, parts = entries.filter("is_query"), []
    wanted = min(k + 1, total)
    while True:
        found = materialize(
            _search(entries, queries, forest, level=level, k=k, block_rows=block_rows, total=total)
            .groupBy("query", "candidate").agg(F.max("score").alias("score"), F.max("bits").alias("bits"))
        )
        enough = materialize(found.groupBy("query").count().filter(F.col("count") >= wanted).select(F.col("query").alias("key")))
        if level == 0 or queries.count() == enough.count():
            parts.append(found)
            break
        parts.append(found.join(enough.withColumnRenamed("key", "query"), "query", "left_semi"))
        queries, level = queries.join(enough, "key", "left_anti"), level - 1

    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    near = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    shown = near.join(members.filter("place is not null").select(F.col("key").alias("candidate"), "vec_id"), "candidate")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        shown.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "bits"))).alias("near"))
    )
    asked = members.filter("place is null").select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"))
    own_first = asked.join(lists, "query").select(
        "query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near")
    )
    return own_first.select("query_id", F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"),
        F.col("n.bits").alias("bits"),
    )
