"""Pair, label and compare tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import ContractError
from .checks import display_keys, require_unique_nonempty

# Tables at most this large may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def missing_keys(inputs: DataFrame, targets: DataFrame, key: str = "stem") -> DataFrame:
    """Keys present on one side only: ``side`` is the side that lacks the key."""
    left = inputs.select(key).distinct()
    right = targets.select(key).distinct()
    return (
        left.withColumn("_l", F.lit(1))
        .join(right.withColumn("_r", F.lit(1)), key, "full_outer")
        .filter("_l is null or _r is null")
        .select(F.when(F.col("_r").isNull(), "target").otherwise("input").alias("side"), key)
    )


def require_complete(inputs: DataFrame, targets: DataFrame, key: str = "stem") -> None:
    gone = missing_keys(inputs, targets, key)
    counts = {r["side"]: r["count"] for r in gone.groupBy("side").count().collect()}
    if counts:
        parts = [
            f"missing {side}(s) for: {display_keys(gone.filter(F.col('side') == side), key)}"
            for side in ("target", "input")
            if side in counts
        ]
        raise ContractError("pairing failed; " + "; ".join(parts))


def pair(inputs: DataFrame, targets: DataFrame, key: str = "stem", require_full: bool = True) -> DataFrame:
    """Inner join of two sides whose other columns become ``input_*`` and ``target_*``.

    Pair file listings rather than decoded images: only names are shuffled then, and both
    files of a pair are read by the task that needs them.
    """
    if require_full:
        for side in (inputs, targets):
            require_unique_nonempty(side, key)
        require_complete(inputs, targets, key)

    def named(df, prefix):
        return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])

    return named(inputs, "input").join(named(targets, "target"), key)


def pair_listings(inputs: DataFrame, targets: DataFrame, columns=("path", "relpath", "length"),
                  key: str = "stem") -> DataFrame:
    """Pair two file listings in one shuffle of names; gaps and duplicates raise.

    Same result as :func:`pair` on ``columns``, but uniqueness, completeness and the join
    itself come from a single aggregation over the union of both sides.
    """
    union = inputs.select(key, *columns, F.lit(True).alias("_in")).unionByName(
        targets.select(key, *columns, F.lit(False).alias("_in"))
    )
    sides = (("input", F.col("_in")), ("target", ~F.col("_in")))
    grouped = union.groupBy(key).agg(
        *[F.count(F.when(flag, 1)).alias(f"_{side}s") for side, flag in sides],
        *[F.max(F.when(flag, F.col(c))).alias(f"{side}_{c}") for side, flag in sides for c in columns],
    )
    problem = (
        F.when(F.trim(key) == "", "empty stem")
        .when((F.col("_inputs") > 1) | (F.col("_targets") > 1), "duplicate stem")
        .when(F.col("_targets") == 0, "missing target for")
        .when(F.col("_inputs") == 0, "missing input for")
    )
    found = grouped.select(key, problem.alias("p")).filter("p is not null").groupBy("p").agg(F.count("*").alias("n"))
    counts_by_problem = {r["p"]: r["n"] for r in found.collect()}
    if counts_by_problem:
        parts = [
            f"{p}: {display_keys(grouped.filter(problem == p), key)}" for p in sorted(counts_by_problem)
        ]
        raise ContractError("pairing failed; " + "; ".join(parts))
    return grouped.drop("_inputs", "_targets")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting (at most ``limit + 1`` rows are looked at)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def attach_labels(metrics: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add ``split`` and ``texture_cluster``; unmatched rows get the default labels."""
    if labels is None:
        return metrics.withColumn("split", F.lit("all_labeled")).withColumn(
            "texture_cluster", F.lit("unassigned")
        )
    known = labels.select(
        "stem", F.col("split").alias("_split"), F.col("texture_cluster").alias("_cluster")
    )
    return (
        metrics.join(known, "stem", "left")
        .withColumn("split", F.coalesce("_split", F.lit("all_labeled")))
        .withColumn("texture_cluster", F.coalesce("_cluster", F.lit("unassigned")))
        .drop("_split", "_cluster")
    )


def unknown_keys(df: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    return df.select(key).join(labels.select(key), key, "left_anti")


def require_known(df: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    gone = unknown_keys(df, labels, key)
    if not gone.isEmpty():
        raise ContractError(f"manifest is missing discovered {key}(s): {display_keys(gone, key)}")
    return df


def severity_grid(images: DataFrame, severities, methods=None) -> DataFrame:
    """Every image at every severity (and method): rows multiply in place, without a join."""
    grid = images.withColumn("severity", F.explode(F.array(*[F.lit(s) for s in severities])))
    if methods is None:
        return grid
    return grid.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def diff_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Set difference both ways: ``side`` names where the key occurs (``a`` or ``b``)."""
    found = missing_keys(a, b, key)
    return found.select(F.when(F.col("side") == "target", "a").otherwise("b").alias("side"), key)


def union_methods(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def label_members(df: DataFrame, members: DataFrame, key: str, then: str, otherwise: str,
                  column: str = "split") -> DataFrame:
    """``then`` for rows whose key is in ``members``, else ``otherwise``."""
    marked = members.select(key).distinct().withColumn("_in", F.lit(True))
    return (
        df.drop(column).join(marked, key, "left")
        .withColumn(column, F.when(F.col("_in"), then).otherwise(otherwise))
        .drop("_in")
    )


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def count_map(df: DataFrame, key: str) -> DataFrame:
    """One row with a key-sorted ``MAP<key, count>``; meant for low-cardinality labels."""
    return counts(df, key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count")))).alias("counts")
    )
