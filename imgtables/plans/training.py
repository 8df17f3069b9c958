"""Train-only degradation profile and materialised training pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ContractError
from ..functions import kernels
from ..functions.columns import hash_uniform
from ..functions.imaging import ImageBatch, RESIDUAL_FIELDS, image_array, residual_features
from ..operators.checks import require_train
from ..operators.quantiles import clipped_range, exact_quantiles
from ..schema import IMAGE_DDL
from ..session import materialize


def fit_profile(pairs: DataFrame, manifest_sha256: str | None = None, split: str = "train",
                input_col: str = "input", target_col: str = "target") -> DataFrame:
    """One-row table with the ``profile`` struct fitted on training pairs only."""
    train = require_train(pairs, split) if "split" in pairs.columns else pairs
    # Materialised, so that the quantile passes read four doubles per pair and no pixels.
    features = materialize(train.select(residual_features(input_col, target_col).alias("f")).select("f.*"))
    values = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in RESIDUAL_FIELDS]
    long = features.select(F.inline(F.array(*values)))
    q = exact_quantiles(long, ["feature"], "value", [0.1, 0.9])
    return profile_from_quantiles(q, manifest_sha256)


def profile_from_quantiles(q: DataFrame, manifest_sha256: str | None = None) -> DataFrame:
    """Assemble the profile from the per-feature 10 % and 90 % quantiles."""
    def pick(name):
        return F.max(F.when(F.col("feature") == name, F.col("q")))

    row = q.agg(F.max("n").alias("n"), *[pick(c).alias(c) for c in RESIDUAL_FIELDS])
    enough = F.when(F.col("n") >= 2, F.col("n")).otherwise(
        F.raise_error(F.lit("at least two training pairs are required")).cast("bigint")
    )
    bias = F.struct(
        F.element_at("residual_mean", 1).alias("low"), F.element_at("residual_mean", 2).alias("high")
    )
    # Multipliers and caps of the fitted ranges.
    return row.select(
        F.struct(
            F.lit(1).alias("schema_version"),
            F.lit("train").alias("fit_split"),
            enough.alias("fit_pair_count"),
            F.lit(manifest_sha256).cast("string").alias("manifest_sha256"),
            clipped_range(F.col("blur_proxy"), cap=1.5).alias("blur_sigma"),
            clipped_range(F.col("residual_std"), 0.70, 0.20).alias("gaussian_noise_std"),
            clipped_range(F.col("speckle_mad"), 0.30, 0.30).alias("speckle_std"),
            bias.alias("additive_bias"),
            F.array(F.lit("area"), F.lit("bicubic")).alias("downsample_modes"),
            F.lit("uniform_random_per_sample").alias("operation_order"),
            F.lit(False).alias("output_clipped"),
            F.lit(False).alias("public_test_used"),
        ).alias("profile")
    )


def _draw(seed: int, what: str, epoch: Column, stem: str) -> Column:
    return hash_uniform(F.concat_ws(":", F.lit(str(seed)), F.lit(what), epoch.cast("string"), F.col(stem)))


def materialize_training(pairs: DataFrame, d4: bool = False, synthetic_p: float = 0.0,
                         profile: dict | None = None, epochs: int = 1, seed: int = 2026,
                         input_col: str = "input", target_col: str = "target") -> DataFrame:
    """Augmented training pairs: ``stem, epoch, transform, synthetic, input, target``.

    Every draw is a hash of ``(seed, epoch, stem)``, so output does not depend on
    partitioning. The same dihedral transform is applied to both images of a pair.
    """
    if not 0.0 <= synthetic_p <= 1.0:
        raise ContractError("synthetic_p must be in [0, 1]")
    if synthetic_p and profile is None:
        raise ContractError("synthetic training needs a fitted degradation profile")
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    plan = pairs.select("stem", input_col, target_col, epoch.alias("epoch"))
    turn = F.floor(_draw(seed, "d4", F.col("epoch"), "stem") * 8).cast("int") if d4 else F.lit(0)
    plan = plan.withColumn("transform", turn).withColumn(
        "synthetic", _draw(seed, "synthetic", F.col("epoch"), "stem") < synthetic_p
    )
    pair_ddl = f"struct<input:{IMAGE_DDL},target:{IMAGE_DDL}>"

    @F.arrow_udf(pair_ddl)
    def augment(low: pa.Array, high: pa.Array, turns: pa.Array, synth: pa.Array, keys: pa.Array) -> pa.Array:
        a, b = ImageBatch(low), ImageBatch(high)
        turns, synth, keys = turns.to_pylist(), synth.to_pylist(), keys.to_pylist()
        left, right = [None] * len(keys), [None] * len(keys)
        for rows in a.groups(b):
            for i, x, y in zip(rows, a.stack(rows), b.stack(rows)):
                if y.shape != (2 * x.shape[0], 2 * x.shape[1]):
                    raise ValueError(f"{keys[i]}: target is not 2x the input")
                y = np.ascontiguousarray(kernels.d4(y, turns[i]))
                right[i] = y
                left[i] = (
                    kernels.synthesize(y, profile, kernels.row_seed(seed, keys[i]))
                    if synth[i] else kernels.d4(x, turns[i])
                )
        return pa.StructArray.from_arrays([image_array(left), image_array(right)], names=["input", "target"])

    key = F.concat_ws("|", F.col("epoch").cast("string"), "stem")
    made = augment(F.col(input_col), F.col(target_col), F.col("transform"), F.col("synthetic"), key)
    return plan.select("stem", "epoch", "transform", "synthetic", made.alias("_p")).select(
        "stem", "epoch", "transform", "synthetic", "_p.input", "_p.target"
    )
