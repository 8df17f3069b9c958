"""Exact-size selections, rankings and quotas that never rank a whole table in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import ContractError
from ..functions.columns import is_finite, rank_key
from ..schema import LOWER_IS_BETTER
from ..session import materialize
from .pairing import small
from .quantiles import SMALL_GROUPS, exact_quantiles, group_sizes

_BUCKET_ROWS = 2_000  # rows wanted in one histogram bucket of the rank key
_MAX_DIGITS = 5  # at most 16^5 buckets per group
TIE_ROWS = 1_000_000  # most tied rows that one task may order


# --- hash holdouts -----------------------------------------------------------------


def _cutoffs(ranked: DataFrame, groups, quotas: DataFrame) -> DataFrame:
    """Per group, the ``quota``-th lowest ``(_key, stem)``.

    A histogram of key prefixes, counted map-side, finds the one bucket that holds the
    cutoff; only that bucket's rows are ranked. Hash keys are uniform, so the prefix length
    follows from the group size alone.
    """
    largest, found = group_sizes(ranked, groups)
    few = F.broadcast if found <= SMALL_GROUPS else (lambda df: df)
    digits = math.ceil(math.log(max(largest / _BUCKET_ROWS, 1), 16))
    digits = min(max(digits, 1), _MAX_DIGITS)
    prefix = F.substring("_key", 1, digits)
    hist = ranked.groupBy(*groups, prefix.alias("_p")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_p"))
    edge = (
        hist.withColumn("_upto", upto)
        .join(few(quotas), list(groups))
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_c") < F.col("quota")))
        .select(*groups, "_p", (F.col("quota") - (F.col("_upto") - F.col("_c"))).alias("_need"))
    )
    position = F.row_number().over(Window.partitionBy(*groups).orderBy("_key", "stem"))
    return (
        ranked.withColumn("_p", prefix)
        .join(few(edge), [*groups, "_p"])
        .withColumn("_pos", position)
        .filter(F.col("_pos") == F.col("_need"))
        .select(*groups, F.col("_key").alias("_cut_key"), F.col("stem").alias("_cut_stem"))
    )


def _at_or_below() -> Column:
    below = F.col("_key") < F.col("_cut_key")
    tie = (F.col("_key") == F.col("_cut_key")) & (F.col("stem") <= F.col("_cut_stem"))
    return F.coalesce(below | tie, F.lit(False))


def holdout_size(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction), 0).cast("bigint")))


def hash_holdout(manifest: DataFrame, fraction: float = 0.15, seed: int = 2026) -> DataFrame:
    """Exact-size holdout: the lowest seeded hash keys become ``val_id``, the rest ``train``.

    The rows themselves are never shuffled: the cutoff key is one scalar subquery.
    """
    if not 0 < fraction < 1:
        raise ContractError("fraction must lie strictly between 0 and 1")
    keyed = manifest.withColumn("_key", rank_key(F.trim("stem"), seed))
    ranked = keyed.select(F.lit(0).alias("_g"), "_key", F.trim("stem").alias("stem"))
    count = F.count("*")
    enough = F.when(count >= 2, holdout_size(count, fraction)).otherwise(
        F.raise_error(F.lit("a holdout needs at least two rows")).cast("bigint")
    )
    quotas = ranked.groupBy("_g").agg(enough.alias("quota"))
    cut = _cutoffs(ranked, ["_g"], quotas).select(
        F.struct(F.col("_cut_key").alias("_key"), F.col("_cut_stem").alias("stem"))
    )
    chosen = F.struct("_key", F.trim("stem").alias("stem")) <= cut.scalar()
    return keyed.withColumn("split", F.when(chosen, "val_id").otherwise("train")).drop("_key")


def stratified_holdout(df: DataFrame, quotas: DataFrame, group: str, seed: int = 2026,
                       tag: str = "val_id") -> DataFrame:
    """Flag ``held_out``: per group, its ``quota`` lowest hash keys. Quotas must be few rows."""
    keyed = df.withColumn("_key", rank_key(F.trim("stem"), seed, tag))
    cut = _cutoffs(keyed.select(group, "_key", "stem"), [group], quotas.select(group, "quota"))
    return (
        # The cut has one row per quota, so counting the quotas does not run it twice.
        keyed.join(F.broadcast(cut) if quotas.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS else cut, group, "left")
        .withColumn("held_out", _at_or_below())
        .drop("_key", "_cut_key", "_cut_stem")
    )


def take_quota(ranked: DataFrame, quotas: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """Rows whose rank lies within their group's quota (quotas: one row per group)."""
    return ranked.join(small(quotas.select(group, "quota")), group).filter(
        F.col(rank) <= F.col("quota")
    ).drop("quota")


# --- ordered selections ---------------------------------------------------------------


def global_rank(df: DataFrame, *order) -> DataFrame:
    """Add 0-based ``_rank`` of a total order by range partitions and their offsets.

    Rows are sorted in parallel; only one count per partition is combined centrally.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = materialize(
        df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_rank", F.col("_before") + local)
        .drop("_at", "_part", "_before")
    )


def worst_condition(metrics: DataFrame, metric: str = "psnr_db", fraction: float = 0.1, tie: str = "stem") -> Column:
    """Which rows :func:`worst_fraction` keeps, as a condition on ``metric`` and ``tie``; never NULL."""
    finite = metrics.filter(is_finite(metric))
    sizes = metrics.agg(
        F.count("*").alias("n"), F.count(F.when(is_finite(metric), 1)).alias("finite")
    ).first()
    wanted = min(max(1, math.ceil(sizes["n"] * fraction)), sizes["finite"])
    known = F.coalesce(is_finite(metric), F.lit(False))
    if wanted <= 0 or wanted == sizes["finite"]:
        return known
    position = (wanted - 1) / max(sizes["finite"] - 1, 1)
    cutoff = exact_quantiles(finite, [], metric, [position], kind="nearest").first()["q"][0]
    tally = finite.agg(
        F.count(F.when(F.col(metric) < cutoff, 1)).alias("below"),
        F.count(F.when(F.col(metric) == cutoff, 1)).alias("tied"),
    ).first()
    need = wanted - tally["below"]
    if need == tally["tied"]:
        return known & (F.col(metric) <= cutoff)
    tied = finite.filter(F.col(metric) == cutoff).select(tie)
    if tally["tied"] <= TIE_ROWS:
        last = tied.orderBy(tie).limit(need).agg(F.max(tie)).first()[0]
    else:
        last = global_rank(tied, tie).filter(F.col("_rank") == need - 1).first()[tie]
    return known & (
        (F.col(metric) < cutoff) | ((F.col(metric) == cutoff) & F.coalesce(F.col(tie) <= F.lit(last), F.lit(False)))
    )


def worst_fraction(metrics: DataFrame, metric: str = "psnr_db", fraction: float = 0.1,
                   tie: str = "stem") -> DataFrame:
    """Finite rows with the lowest metric, ``max(1, ceil(fraction*n))`` of all ``n`` rows.

    The cutoff value is an exact order statistic; ties at the cutoff go to the lowest
    ``tie`` keys. The selection itself is a plain filter.
    """
    return metrics.filter(worst_condition(metrics, metric, fraction, tie))


def stable_order(df: DataFrame, key: str = "stem") -> DataFrame:
    """Total order by key; UTF-8 byte order equals code-point order."""
    return df.orderBy(key)


def first_n(df: DataFrame, n: int, key: str = "stem") -> DataFrame:
    """The first ``n`` rows by key; asking for more rows than there are is an error."""
    if n < 1 or df.limit(n).count() < n:
        raise ContractError(f"cannot take {n} rows")
    return df.orderBy(key).limit(n)


def worst_k(metrics: DataFrame, k: int, metric: str = "psnr_db", tie: str = "stem") -> DataFrame:
    """The ``k`` lowest-scoring rows for a report panel; rows without a finite score are no candidates."""
    if k < 1:
        raise ContractError("k must be at least 1")
    return metrics.filter(is_finite(metric)).orderBy(metric, tie).limit(k)


def extremes(deltas: DataFrame, keys, value: str = "delta_psnr_db", label: str = "relative_path") -> DataFrame:
    """Smallest and largest value per group with the row that attains it."""
    rows = deltas.filter(F.col(value).isNotNull())
    low, high = F.min(F.struct(value, label)), F.max(F.struct(value, label))
    return rows.groupBy(*keys).agg(low.alias("_lo"), high.alias("_hi")).select(
        *keys,
        F.col("_lo")[value].alias("min_value"), F.col("_lo")[label].alias("min_label"),
        F.col("_hi")[value].alias("max_value"), F.col("_hi")[label].alias("max_label"),
    )


# --- ranks and choices over small decision tables ----------------------------------------


def competition_rank(df: DataFrame, metric: str, higher_is_better: bool | None = None,
                     keys=("split",)) -> Column:
    """Rank column: equal values share a rank, the next value skips ahead."""
    if higher_is_better is None:
        higher_is_better = metric not in LOWER_IS_BETTER
    order = F.col(metric).desc() if higher_is_better else F.col(metric).asc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order))


def pick_ood_clusters(sizes: DataFrame, target: int) -> DataFrame:
    """Greedy whole-cluster holdout on a table of one row per cluster.

    Input ``cluster, size, distance``. Clusters are taken by falling distance while the
    total moves closer to ``target``; the first is always taken. Adds ``ood``.
    """
    w = Window.orderBy(F.desc("distance"), F.asc("cluster"))
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    walked = sizes.withColumn("_pos", F.row_number().over(w)).withColumn("_upto", upto).withColumn(
        "_before", F.col("_upto") - F.col("size")
    )
    stop = (F.col("_pos") > 1) & (
        (F.col("_before") >= target)
        | (F.abs(F.col("_before") - target) <= F.abs(F.col("_upto") - target))
    )
    stopped = F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return walked.withColumn("ood", stopped == 0).drop("_pos", "_upto", "_before")


def largest_remainder(sizes: DataFrame, target: int) -> DataFrame:
    """Integer quotas proportional to cluster sizes that add up to ``target``.

    Input ``cluster, size`` (one row per cluster). Floors first, then one row at a time
    by falling remainder, in rounds; at least one row of each cluster stays outside.
    """
    whole = sizes.agg(
        F.sum("size").alias("rows"),
        F.sum(F.greatest(F.col("size") - 1, F.lit(0))).alias("room"),
    ).first()
    if not whole["rows"] or whole["room"] < target:
        raise ContractError("could not allocate validation rows")
    # Rate first, then product: the same order of operations everywhere keeps ties equal.
    share = F.col("size") * F.lit(target / whole["rows"])
    cap = F.greatest(F.col("size") - 1, F.lit(0)).cast("bigint")
    base = F.greatest(F.least(F.col("size") - 1, F.floor(share)), F.lit(0)).cast("bigint")
    table = sizes.withColumn("_base", base).withColumn("_room", cap - base).withColumn(
        "_rank", F.row_number().over(Window.orderBy((share - base).desc(), "cluster"))
    )
    left = target - table.agg(F.sum("_base")).first()[0]
    # Whole rounds until fewer rows than open clusters remain; rooms are few distinct numbers.
    rooms = [r["_room"] for r in table.select("_room").collect()]
    full, spent = 0, 0
    while True:
        open_clusters = sum(r > full for r in rooms)
        if not open_clusters or left - spent < open_clusters:
            break
        spent += open_clusters
        full += 1
    extra = left - spent
    still_open = (F.col("_room") > full).cast("int")
    turn = F.sum(still_open).over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    given = F.least(F.col("_room"), F.lit(full)) + F.when(
        (still_open == 1) & (turn <= extra), 1
    ).otherwise(0)
    return table.withColumn("quota", (F.col("_base") + given).cast("bigint")).drop(
        "_base", "_room", "_rank"
    )
