"""Compare two runs' parameter tables, and reports over training histories and timings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import ContractError
from ..functions.pixels import max_abs_difference, validation_psnr_from_mse
from ..session import materialize
from .quantiles import BUFFER_ROWS, SMALL_GROUPS, exact_quantiles, join_groups

DIGEST_VALUES = 4096  # values under one digest
_BLOCK = 65_536  # steps per block of a running aggregate


def _digests(values, block: int) -> Column:
    """Struct ``n, root, blocks``: a digest per block of values and one over them, NULL where equal bytes prove nothing.

    That is the case for a block with NULL, NaN or infinite values, whose difference is no number.
    """

    @F.arrow_udf("struct<n:int,root:string,blocks:array<string>>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for values in column:
            if not values.is_valid:
                rows.append(None)
                continue
            x = values.values.to_numpy(zero_copy_only=False)
            plain = np.isfinite(x.astype(np.float64)) if len(x) else np.zeros(0, bool)
            starts = range(0, len(x), block)
            blocks = [hashlib.sha256(x[i:i + block].tobytes()).hexdigest() if plain[i:i + block].all() else None for i in starts]
            root = None if None in blocks else hashlib.sha256(f"{len(x)}:{','.join(blocks)}".encode()).hexdigest()
            rows.append({"n": len(x), "root": root, "blocks": blocks})
        return pa.array(rows, pa.struct([("n", pa.int32()), ("root", pa.string()), ("blocks", pa.list_(pa.string()))]))

    return run(values)


def tensor_digests(df: DataFrame, block: int = DIGEST_VALUES) -> DataFrame:
    """``tensor, dtype, shape, n, root, blocks``: what two runs exchange before any value."""
    return df.select("tensor", "dtype", "shape", _digests(F.col("values"), block).alias("d")).select("tensor", "dtype", "shape", "d.*")


def suspect_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """``tensor, block`` of two digest tables whose blocks may differ, for tensors of equal metadata."""
    left, right = (t.select("tensor", *[F.col(c).alias(f"_{s}_{c}") for c in ("dtype", "shape", "n", "root", "blocks")]) for s, t in (("a", a), ("b", b)))
    same = F.col("_a_n").eqNullSafe(F.col("_b_n"))
    for c in ("dtype", "shape"):
        same = same & F.coalesce(F.col(f"_a_{c}") == F.col(f"_b_{c}"), F.lit(True))
    differ = left.join(right, "tensor").filter(same & ~F.coalesce(F.col("_a_root") == F.col("_b_root"), F.lit(False)))
    unlike = F.zip_with("_a_blocks", "_b_blocks", lambda x, y: ~F.coalesce(x == y, F.lit(False)))
    return differ.select("tensor", F.posexplode(unlike).alias("block", "_unlike")).filter("_unlike").select("tensor", "block")


def compare_tensors(a: DataFrame, b: DataFrame, block: int = DIGEST_VALUES) -> DataFrame:
    """Per tensor: ``tensor, error, max_abs_diff``; metadata differences become errors.

    Both runs first meet in digests: one per tensor decides most, digests per block name what is
    left, and only the values of those blocks are sent and compared.
    """
    known = [materialize(tensor_digests(side, block)) for side in (a, b)]
    left, right = (
        t.select("tensor", *[F.col(c).alias(f"_{s}_{c}") for c in ("dtype", "shape", "n")]) for s, t in zip("ab", known)
    )
    both = left.join(right, "tensor", "full_outer")
    error = F.when(
        F.col("_a_dtype").isNull() | F.col("_b_dtype").isNull(), F.lit("tensor keys differ")
    ).when(
        (F.col("_a_dtype") != F.col("_b_dtype")) | (F.col("_a_shape") != F.col("_b_shape"))
        | ~F.col("_a_n").eqNullSafe(F.col("_b_n")),
        F.lit("tensor metadata differs"),
    )
    suspects = materialize(suspect_blocks(*known))
    lists = suspects.groupBy("tensor").agg(F.collect_list("block").alias("_blocks"))  # no longer than the tensor's own row
    few = F.broadcast if suspects.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS else (lambda df: df)

    def values_of(side: DataFrame, name: str) -> DataFrame:
        cut = F.transform("_blocks", lambda i: F.struct(i.alias("block"), F.slice("values", i * block + 1, F.lit(block)).alias(name)))
        return side.select("tensor", "values").join(few(lists), "tensor").select("tensor", F.inline(cut))

    compared = values_of(a, "_x").join(values_of(b, "_y"), ["tensor", "block"])
    found = compared.groupBy("tensor").agg(F.max(max_abs_difference("_x", "_y")).alias("_d"))
    rows = both.select("tensor", error.alias("error")).join(found, "tensor", "left")
    return rows.select("tensor", "error", F.when(F.col("error").isNull(), F.coalesce("_d", F.lit(0.0))).alias("max_abs_diff"))


def max_difference(compared: DataFrame, atol: float = 0.0) -> DataFrame:
    """One row: largest difference, the first tensor attaining it, and ``passed``.

    The tensor is NULL when nothing differs. Any metadata error makes ``passed`` false.
    """
    if atol < 0:
        raise ContractError("atol cannot be negative")
    best = F.min(F.when(F.col("max_abs_diff") > 0, F.struct((-F.col("max_abs_diff")).alias("d"), "tensor")))
    row = compared.agg(
        F.coalesce(F.max("max_abs_diff"), F.lit(0.0)).alias("max_abs_diff"),
        best["tensor"].alias("tensor"),
        F.count("error").alias("errors"),
    )
    return row.withColumn("passed", (F.col("errors") == 0) & (F.col("max_abs_diff") <= atol))


# --- training history ---------------------------------------------------------------


def _running(df: DataFrame, value: str, agg, out: str, keys, order: str, inclusive: bool) -> DataFrame:
    """Running aggregate in order, computed per block of steps and carried between blocks.

    A long run is split into blocks of steps, so no task holds a whole run.
    """
    block = F.floor(F.col(order) / F.lit(_BLOCK)).alias("_blk")
    blocks = df.groupBy(*keys, block).agg(agg(value).alias("_top"))
    carried = agg("_top").over(
        Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = blocks.select(*keys, "_blk", carried.alias("_carry"))
    end = 0 if inclusive else -1
    inner = agg(value).over(
        Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    )
    join = F.least if agg is F.min else F.greatest  # both skip NULLs
    return (
        df.withColumn("_blk", F.floor(F.col(order) / F.lit(_BLOCK)))
        .withColumn("_inner", inner)
        .transform(lambda rows: join_groups(rows, carry, [*keys, "_blk"]))
        .withColumn(out, join("_inner", "_carry"))
        .drop("_blk", "_inner", "_carry")
    )


def running_best(history: DataFrame, keys=("run",)) -> DataFrame:
    """Add ``best_train_loss`` so far and ``is_new_best`` (selected PSNR strictly above all before)."""
    loss = _running(history.drop("best_train_loss"), "train_loss", F.min, "best_train_loss", keys, "step", True)
    seen = _running(loss, "selected_val_psnr_db", F.max, "_seen", keys, "step", False)
    new = F.col("selected_val_psnr_db").isNotNull() & (
        F.col("_seen").isNull() | (F.col("selected_val_psnr_db") > F.col("_seen"))
    )
    return seen.withColumn("is_new_best", new).drop("_seen")


def run_summary(history: DataFrame, keys=("run",)) -> DataFrame:
    """First, last and best loss, their ratio, best PSNR and the step it was first reached."""
    best = F.max(
        F.when(
            F.col("selected_val_psnr_db").isNotNull(),
            F.struct("selected_val_psnr_db", (-F.col("step")).alias("s"), "selected_weights"),
        )
    )
    return history.groupBy(*keys).agg(
        F.max("step").alias("steps"),
        F.min_by("train_loss", "step").alias("initial_train_loss"),
        F.max_by("train_loss", "step").alias("final_train_loss"),
        F.min("train_loss").alias("best_train_loss"),
        (F.min("train_loss") / F.min_by("train_loss", "step")).alias("loss_reduction_ratio"),
        best["selected_val_psnr_db"].alias("best_val_psnr_db"),
        (-best["s"]).alias("best_step"),
        best["selected_weights"].alias("best_weights_source"),
    )


def validation_psnr(df: DataFrame, mse_col: str = "mse", floor: float = 1e-12, keys=()) -> DataFrame:
    """Mean of per-image PSNR with a floored error."""
    return df.groupBy(*keys).agg(F.avg(validation_psnr_from_mse(mse_col, floor)).alias("val_psnr_db"))


# --- timings ---------------------------------------------------------------------------


def latency_summary(samples: DataFrame, keys=("run",), value: str = "ms", batch_col: str = "batch",
                    buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Mean and nearest-rank median, p90, p95 per run, and images per second; a NULL run is a run."""
    keys = list(keys)
    q = exact_quantiles(samples, keys, value, [0.5, 0.9, 0.95], kind="nearest", buffer_rows=buffer_rows)
    base = samples.groupBy(*keys).agg(F.avg(value).alias("mean_ms"), F.max(batch_col).alias("batch"))
    named = q.select(*keys, "n", *[F.element_at("q", i).alias(a) for i, a in ((1, "median_ms"), (2, "p90_ms"), (3, "p95_ms"))])
    return join_groups(base, named, keys).withColumn(
        "images_per_second", F.col("batch") * F.lit(1000.0) / F.col("median_ms")
    )

