"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

Method: a fingerprint's 64 bits are 32 segments of two bits; the embedding is the vector of
their bit counts. Flipping one bit moves one count by one, so the Manhattan distance of two
embeddings is a lower bound of the Hamming distance. Points within distance 3 are within
distance 1 in the first or the second half of the vector (3 < 2 + 2), so each half is a grid
whose cells are exact half vectors: a point is stored in its own cell and probes its own cell
and the cells one step up in one coordinate. Candidates pass the bound over the whole vector
and are then verified bit by bit.

A cell that holds more than ``hot_cell`` fingerprints is searched by a finer grid: the other
half is within distance 3, hence within 1 in one of its quarters, and that quarter joins the key.
Both ways find every link; the finer one costs more keys per point and fewer pairs.

A count vector is kept in thermometer code (00, 01, 11 per segment), where a step up sets one
bit and the Manhattan distance is the bit count of an exclusive or. Equal fingerprints are
folded before anything else. Fingerprinting is the only Python step and does not shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import ContractError
from ..session import materialize
from .batches import sliced
from .components import connected_components

SEED = 42
MAX_DISTANCE = 3
LOW_BITS = 0x5555555555555555  # the lower bit of each two-bit segment
HOT_CELL = 256

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256


def fingerprint_bytes(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of ASCII-lower-cased words in shingles of ``width``; no word gives zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _LANES
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", width: int = 3, output: str = "fp") -> DataFrame:
    """The rows of ``docs`` without ``text_col`` and with the fingerprint as a signed long.

    A null text has no words and gets fingerprint zero; an existing column ``output`` is replaced.
    """
    passed = [f for f in docs.schema.fields if f.name not in (text_col, output)]
    names = [f.name for f in passed]

    def run(batches):
        for batch in sliced(batches, text_col):
            raw = batch.column(batch.schema.names.index(text_col)).cast(pa.binary())
            found = np.array([fingerprint_bytes(v or b"", width) for v in raw.to_pylist()], np.uint64).view(np.int64)
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*names, output])

    schema = T.StructType([*passed, T.StructField(output, T.LongType())])
    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in thermometer code."""
    above = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(above).bitwiseAND(_long(LOW_BITS))
    both = fp.bitwiseAND(above).bitwiseAND(_long(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _part(embedded: Column, first: int, bits: int) -> Column:
    """``bits`` bits of the embedding from bit ``first`` on: half or quarter of the vector."""
    return F.shiftrightunsigned(embedded, first).bitwiseAND(_long((1 << bits) - 1))


def _steps(cell: Column, bits: int, *, up: bool, down: bool) -> Column:
    """The cell and its neighbours one step away in one coordinate."""

    def bit(j: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), j)

    def step(j: Column) -> Column:
        is_set = cell.bitwiseAND(bit(j)) != 0
        # a lower bit clears only below an unset upper bit, an upper bit sets only above a set lower bit
        other = F.when(j % 2 == 0, cell.bitwiseAND(bit(j + 1)) == 0).otherwise(cell.bitwiseAND(bit(j - 1)) != 0)
        wanted = (F.lit(up) & ~is_set) | (F.lit(down) & is_set)
        return F.when(other & wanted, cell.bitwiseXOR(bit(j)))

    moved = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), step)
    return F.concat(F.array(cell), F.filter(moved, lambda c: c.isNotNull()))


def candidate_links(points: DataFrame, *, hot_cell: int = HOT_CELL) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints at Hamming distance 1 to 3, from ``points(fp)``.

    A pair may be returned twice (once per half). ``points`` must be distinct.
    """
    base = points.select("fp", embed(F.col("fp")).alias("e"))
    halves = F.array(*[
        F.struct(F.lit(h).alias("half"), _part(F.col("e"), 32 * h, 32).alias("own"),
                 _part(F.col("e"), 32 - 32 * h, 32).alias("rest")) for h in (0, 1)
    ])
    placed = base.select("fp", "e", F.inline(halves))
    key = [F.col("half"), F.col("cell")]
    stored = placed.select(F.col("fp").alias("b"), F.col("e").alias("e_b"), "half", F.col("own").alias("cell"), F.col("rest").alias("rest_b"))
    probes = placed.select(
        F.col("fp").alias("a"), F.col("e").alias("e_a"), "half", "own", F.col("rest").alias("rest_a"),
        F.explode(_steps(F.col("own"), 32, up=True, down=False)).alias("cell"),
    )
    # In the same cell both points probe each other, so one order is kept.
    ordered = (F.col("cell") != F.col("own")) | (F.col("a") < F.col("b"))
    near = F.bit_count(F.col("e_a").bitwiseXOR(F.col("e_b"))) <= MAX_DISTANCE
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    hot = materialize(stored.groupBy("half", "cell").count().filter(F.col("count") > hot_cell).select(*key))
    narrow = ["half", "cell"]
    if hot.isEmpty():
        return probes.join(stored, narrow).filter(ordered & near & exact).select("a", "b")
    cold = probes.join(hot, narrow, "left_anti").join(stored.join(hot, narrow, "left_anti"), narrow)

    def keyed(quarter: int):
        return lambda c: F.struct(F.lit(quarter).alias("quarter"), c.alias("fine"))

    def quarters(rest: str, build) -> Column:
        return F.concat(*[F.transform(build(_part(F.col(rest), 16 * q, 16)), keyed(q)) for q in (0, 1)])

    fine_stored = stored.join(hot, narrow).select("*", F.inline(quarters("rest_b", F.array)))
    fine_probes = probes.join(hot, narrow).select(
        "*", F.inline(quarters("rest_a", lambda c: _steps(c, 16, up=True, down=True)))
    )
    fine = fine_probes.join(fine_stored, [*narrow, "quarter", "fine"])
    return (
        cold.filter(ordered & near & exact).select("a", "b")
        .unionByName(fine.filter(ordered & near & exact).select("a", "b").distinct())
    )


def near_prints(points: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints at Hamming distance 1 to 3, in proportion to ``points(fp)``.

    Each point meets the smallest point of its own cell and of each cell one step up, so a large
    group or a dense grid costs no more than its points. For callers that have an exact way to the
    links among the rest; ``candidate_links`` finds every link.
    """
    e = embed(F.col("fp"))
    placed = points.select("fp", F.inline(F.array(*[
        F.struct(F.lit(h << 32).cast("long").alias("half"), _part(e, 32 * h, 32).alias("own")) for h in (0, 1)
    ])))
    firsts = placed.groupBy(F.col("own").bitwiseOR(F.col("half")).alias("cell")).agg(F.min("fp").alias("first"))
    cells = F.transform(_steps(F.col("own"), 32, up=True, down=False), lambda c: c.bitwiseOR(F.col("half")))
    # Spark sizes the exploded cells as one of each point's 34 and would broadcast them.
    met = placed.select("fp", F.explode(cells).alias("cell")).hint("merge").join(firsts, "cell").filter("fp <> first")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= MAX_DISTANCE
    return met.filter(near).select(F.least("fp", "first").alias("a"), F.greatest("fp", "first").alias("b")).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, hot_cell: int = HOT_CELL,
) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), fingerprint (hex), component_id, n_links.

    Fingerprints at 3 or fewer differing bits are linked; ``component_id`` is the smallest id
    reachable over links (null only if no reachable row has an id); ``n_links`` counts the
    other fingerprints that this one is linked to. Null and empty texts have fingerprint zero.
    Repeated rows share one fingerprint. An empty table gives an empty result.
    """
    if width < 1:
        raise ContractError("shingles take at least one word")
    prints = materialize(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width=width))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = materialize(candidate_links(points.select("fp"), hot_cell=hot_cell).distinct())
    both = links.select("a").unionByName(links.select(F.col("b").alias("a")))
    degrees = both.groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_links"))
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = labels.withColumnRenamed("node", "fp").join(points, "fp").join(degrees, "fp")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = labelled.join(smallest, "label").select("fp", "component_id", "n_links")
    # A table of its own, so that the last join meets it and the prints alone and can be split where one
    # fingerprint is very common.
    classes = materialize(points.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    ))
    return prints.join(classes, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )
