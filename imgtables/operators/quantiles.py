"""Exact order statistics of any group size, in bounded memory per task.

``percentile`` buffers every distinct value of a group in one task. Here a mergeable
sketch first brackets each wanted rank, a second pass counts what lies below the bracket
and groups the few values inside it, and the exact order statistic is read from there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.pixels import let

# The sketch's rank error is at most n / ACCURACY; brackets are five times as wide.
ACCURACY = 10_000
_MARGIN = 5.0 / ACCURACY
BUFFER_ROWS = 250_000  # largest group one task may sort in memory
SMALL_GROUPS = 100_000  # most bracket rows that may be broadcast
WHOLE_ROWS = 100_000  # groups up to this size lie wholly inside their bracket


def _rank_bounds(n: Column, prob: float, kind: str):
    """0-based lower and upper ranks and the interpolation weight of one quantile."""
    if kind == "nearest":
        rank = F.bround((n - 1) * F.lit(float(prob)), 0).cast("bigint")
        rank = F.greatest(F.lit(0), F.least(n - 1, rank))
        return rank, rank, F.lit(0.0)
    pos = (n - 1) * F.lit(float(prob))
    low = F.floor(pos).cast("bigint")
    return low, F.ceil(pos).cast("bigint"), pos - low


def sorted_quantiles(value: Column, probs, kind: str = "linear") -> Column:
    """Aggregate: array of quantiles read from the sorted group, NULLs left out.

    About twice as fast as ``percentile``, whose buffer counts distinct boxed values. For
    groups of proven size only.
    """
    def read(ordered: Column) -> Column:
        def one(prob: float) -> Column:
            low, high, weight = _rank_bounds(F.size(ordered), prob, kind)
            a, b = F.get(ordered, low.cast("int")), F.get(ordered, high.cast("int"))
            return a + (b - a) * weight

        return F.array(*[one(float(p)) for p in probs])

    return let(F.array_sort(F.collect_list(value)), read)


def join_groups(left: DataFrame, right: DataFrame, names, how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on group keys that may be NULL: a NULL key is a group like any other."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, same, how)
    return joined.drop(*[f"_r_{n}" for n in names])


def group_sizes(rows: DataFrame, names) -> tuple[int, int]:
    """Largest group and number of groups: the two facts every strategy choice needs."""
    row = rows.groupBy(*names).agg(F.count("*").alias("n")).agg(
        F.max("n").alias("largest"), F.count("*").alias("groups")
    ).first()
    return row["largest"] or 0, row["groups"]


def exact_quantiles(df: DataFrame, keys, value: str, probs, kind: str = "linear",
                    buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """One row per group: keys, ``n`` and ``q`` (array in the order of ``probs``).

    NULL, NaN and infinite values must be filtered out by the caller. ``kind`` is
    ``linear`` (interpolated) or ``nearest`` (the value at the half-even rounded rank).
    Groups proven to have at most ``buffer_rows`` rows are sorted whole.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    names = keys or ["_all"]
    rows = df.select(
        *(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")
    )
    largest, groups = group_sizes(rows, names)
    if largest <= buffer_rows:
        q = sorted_quantiles(F.col("_v"), probs, kind)
        return rows.groupBy(*names).agg(F.count("*").alias("n"), q.alias("q")).select(*keys, "n", "q")
    return _bracketed(rows, names, probs, kind, groups).select(*keys, "n", "q")


def _bracketed(rows: DataFrame, names, probs, kind: str, groups: int) -> DataFrame:
    brackets = [max(0.0, min(1.0, p + s * _MARGIN)) for p in probs for s in (-1, 1)]
    sketch = rows.groupBy(*names).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", brackets, F.lit(ACCURACY)).alias("_b"),
    )

    def span(i, p):
        r0, r1, w = _rank_bounds(F.col("n"), p, kind)
        # The margin is a share of n; only a large group's margin spans both ranks.
        whole = F.col("n") <= WHOLE_ROWS
        lo, hi = F.element_at("_b", 2 * i + 1), F.element_at("_b", 2 * i + 2)
        return F.struct(
            F.lit(i).alias("i"),
            F.when(whole, F.lit(-math.inf)).otherwise(lo).alias("lo"),
            F.when(whole, F.lit(math.inf)).otherwise(hi).alias("hi"),
            r0.alias("r0"), r1.alias("r1"), w.cast("double").alias("w"),
        )

    spans = sketch.select(*names, "n", F.inline(F.array(*[span(i, p) for i, p in enumerate(probs)])))
    joined = join_groups(rows, spans, names, broadcast=groups <= SMALL_GROUPS)
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    # Values outside the bracket collapse into one NULL row per group and side count.
    counted = (
        joined.withColumn("_low", (F.col("_v") < F.col("lo")).cast("bigint"))
        .withColumn("_in", inside.cast("bigint"))
        .withColumn("_v", F.when(inside, F.col("_v")))
        .groupBy(*names, "i", "n", "r0", "r1", "w", "_v")
        .agg(F.sum("_low").alias("below"), F.sum("_in").alias("c"))
    )
    group = Window.partitionBy(*names, "i")
    running = counted.withColumn(
        "upto", F.sum("below").over(group) + F.sum("c").over(group.orderBy("_v"))
    )

    def at(rank):
        hit = (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("c"))
        return F.max(F.when(hit, F.col("_v")))

    values = running.groupBy(*names, "i", "n", "w").agg(at("r0").alias("a"), at("r1").alias("b"))
    exact = F.when(
        F.col("a").isNull() | F.col("b").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))
    by_prob = F.array_sort(F.collect_list(F.struct("i", exact.alias("x"))))
    return values.groupBy(*names, "n").agg(F.transform(by_prob, lambda s: s["x"]).alias("q"))


def clipped_range(q: Column, multiplier: float = 1.0, cap: float | None = None) -> Column:
    """Struct ``low, high`` from a two-element quantile array, floored at 0 and capped."""
    low, high = (F.greatest(F.lit(0.0), F.element_at(q, i) * F.lit(multiplier)) for i in (1, 2))
    if cap is not None:
        low, high = F.least(low, F.lit(cap)), F.least(high, F.lit(cap))
    return F.struct(low.alias("low"), F.greatest(low, high).alias("high"))
