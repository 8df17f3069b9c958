"""Gates: each is one aggregation that raises with a short, bounded sample of offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import ContractError
from ..functions.columns import casefold_key, path_error


def display_keys(df: DataFrame, key: str, limit: int = 10) -> str:
    """First sorted keys and how many more there are: ``a, b, ... (+n more)``."""
    row = key_sample(df, key, limit).first()
    return row["display"]


def key_sample(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The text of :func:`display_keys` as a one-row table; only ``limit`` keys travel."""
    keys = df.select(F.col(key).cast("string").alias("k")).distinct()
    shown = keys.orderBy("k").limit(limit).agg(F.array_sort(F.collect_list("k")).alias("a"))
    total = keys.agg(F.count("*").alias("n"))
    text = F.concat_ws(", ", "a")
    extra = F.col("n") - limit
    return shown.withColumn("n", total.scalar()).select(
        F.when(extra > 0, F.concat(text, F.lit(", ... (+"), extra.cast("string"), F.lit(" more)")))
        .otherwise(text)
        .alias("display")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are blank or occur more than once, with their counts."""
    k = F.trim(F.col(key).cast("string"))
    return (
        df.groupBy(F.coalesce(k, F.lit("")).alias(key))
        .agg(F.count("*").alias("count"))
        .filter((F.col("count") > 1) | (F.col(key) == ""))
    )


def require_unique_nonempty(df: DataFrame, key: str) -> DataFrame:
    bad = duplicate_keys(df, key).orderBy(key).limit(10).collect()
    if bad:
        names = ", ".join(repr(r[key]) for r in bad)
        raise ContractError(f"empty or duplicate {key}: {names}")
    return df


def path_collisions(df: DataFrame, path_col: str = "relpath") -> DataFrame:
    """Relative paths that differ only by letter case."""
    return (
        df.groupBy(casefold_key(path_col).alias("key"))
        .agg(F.count("*").alias("count"), F.min(path_col).alias("first"), F.max(path_col).alias("last"))
        .filter("count > 1")
    )


def require_unique(df: DataFrame, path_col: str = "relpath") -> DataFrame:
    bad = path_collisions(df, path_col).limit(10).collect()
    if bad:
        pairs = "; ".join(f"{r['first']} and {r['last']}" for r in bad)
        raise ContractError(f"paths collide in the output: {pairs}")
    return df


def require_count(df: DataFrame, expected: int | None, what: str = "rows") -> DataFrame:
    if expected is not None:
        found = df.count()
        if found != expected:
            raise ContractError(f"expected {expected} {what}, found {found}")
    return df


def check_paths(df: DataFrame, path_col: str, files: DataFrame | None = None) -> DataFrame:
    """Add ``error``: unsafe relative path, or a path absent from a file listing."""
    error = path_error(path_col)
    if files is None:
        return df.withColumn("error", error)
    known = files.select(F.col("relpath").alias("_known")).distinct()
    joined = df.join(known, F.col(path_col) == F.col("_known"), "left")
    missing = F.when(F.col("_known").isNull(), F.lit("file does not exist"))
    return joined.withColumn("error", F.coalesce(error, missing)).drop("_known")


def select_splits(df: DataFrame, splits=None) -> DataFrame:
    """Rows of the named splits (all when none are named); empty selections are errors."""
    if not splits:
        return df
    names = [splits] if isinstance(splits, str) else sorted(splits)
    chosen = df.filter(F.col("split").isin(names))
    if chosen.isEmpty():
        raise ContractError("no rows selected for split: " + ", ".join(names))
    return chosen


def require_train(df: DataFrame, split: str = "train") -> DataFrame:
    """Fitting may only see training rows."""
    if split != "train":
        raise ContractError(f"fitting is restricted to the train split, not '{split}'")
    return select_splits(df, "train")
