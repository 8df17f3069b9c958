"""Exact deduplication through an extendible-hash index on shared files.

Method: every text is hashed to 64 bits. A directory of ``2**depth`` cells maps the leading
bits of a hash to a bucket; a bucket that holds more entries than ``bucket_rows`` is split by
one more bit, and the directory doubles whenever a split needs more bits than it has. Owner
tasks hold contiguous key ranges, that is whole buckets; within a bucket, entries of equal key
but different bytes form a chain. Entries are admitted by an aggregation over the bytes of the
text, so equal keys alone never merge two texts. Copies are folded before the shuffle, so a
text that makes up a third of all rows reaches its owner as one entry per map task.

Everything is DataFrame code; only the directory (one integer pair per cell, at most
``2**MAX_DEPTH``) visits the driver.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

MAX_DEPTH = 20  # cells of the directory: at most 2**20, 16 MB when broadcast


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; a null text is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def cell_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, bucket_rows: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """``(depth, [(first cell, local depth), ...])`` of the buckets, from distinct ``key`` values.

    Buckets above ``bucket_rows`` split until they fit or reach ``max_depth``; there a bucket
    may stay overfull, which costs time but changes no result.
    """
    total = keys.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(total, 1) / bucket_rows))))
    while True:
        seen = min(max_depth, depth + 2)
        counts = {0: {0: total}}
        counts[seen] = dict(map(tuple, keys.groupBy(cell_of(F.col("key"), seen).alias("cell")).count().collect()))
        for level in range(seen - 1, 0, -1):
            counts[level] = {}
            for cell, n in counts[level + 1].items():
                counts[level][cell >> 1] = counts[level].get(cell >> 1, 0) + n
        buckets, overfull, waiting = [], False, [(0, 0)]
        while waiting:
            cell, level = waiting.pop()
            full = counts[level].get(cell, 0) > bucket_rows
            if full and level < seen:
                waiting += [(2 * cell + 1, level + 1), (2 * cell, level + 1)]
            else:
                overfull |= full
                buckets.append((cell, level))
        if not overfull or seen == max_depth:
            depth = max(level for _, level in buckets)
            return depth, [(cell << (depth - level), level) for cell, level in buckets]
        depth = seen


def build_index(heap: DataFrame, *, bucket_rows: int = 50_000, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index table over ``heap(doc_id, key, sha256, n_bytes, norm)``.

    One row per distinct text: bucket, local_depth, key, chain_pos, chain_len, sha256, n_bytes,
    keep_id, group_size. Written once to the shared checkpoint folder.
    """
    spark = heap.sparkSession
    entries = materialize(
        heap.groupBy("key", "sha256", "n_bytes", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .drop("norm")
    )
    depth, buckets = grow_directory(entries.select("key"), bucket_rows, max_depth)
    cells = [(first + i, first, level) for first, level in buckets for i in range(1 << (depth - level))]
    directory = spark.createDataFrame(cells, "cell long, bucket long, local_depth int")
    chain = Window.partitionBy("bucket", "key")
    placed = (
        entries.withColumn("cell", cell_of(F.col("key"), depth))
        .join(F.broadcast(directory), "cell").drop("cell")
        .repartitionByRange("bucket", "key")
        .withColumn("chain_pos", F.row_number().over(chain.orderBy("sha256", "n_bytes", "keep_id")))
        .withColumn("chain_len", F.count("*").over(chain))
        .withColumn("same_digest", F.count("*").over(Window.partitionBy("bucket", "key", "sha256")))
    )
    checked = F.when(F.col("same_digest") > 1, F.raise_error(F.lit("two texts share key and SHA-256"))).otherwise(
        F.col("sha256")
    )
    return materialize(placed.withColumn("sha256", checked).drop("same_digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index_options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, bucket, chain_pos.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of
    equal texts the row with the largest id stays. Rows without an id count in ``group_size``
    and stay only where no row of the group has an id; repeated rows of one id share its fate.
    An empty table gives an empty result. Other columns are not read.
    """
    norm = fold_ascii(F.col(text_col))
    heap = materialize(
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
        .select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha256"),
                F.octet_length("norm").alias("n_bytes"), "norm")
    )
    index = build_index(heap, **index_options)
    # Every heap text is an entry, and entries of one chain have different digests, so
    # (key, sha256) names the one entry whose bytes were compared with this row's.
    found = heap.select("doc_id", "key", "sha256").join(
        index.select("key", "sha256", "n_bytes", "bucket", "chain_pos", "keep_id", "group_size"), ["key", "sha256"]
    )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"), "n_bytes", "bucket", "chain_pos",
    )
