"""Reports over runs: parameter comparison, output verification, history and latency."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..operators.checks import require_count
from ..operators.tensors import compare_tensors, latency_summary, max_difference, run_summary, running_best
from ..sources import list_files
from ..sources.images import profile_npy, read_bytes
from ..sources.listing import spread


def require_same_provenance(a: dict, b: dict, keys=("model_name", "model_config", "manifest_sha256")) -> None:
    differs = [k for k in keys if a.get(k) is None or a.get(k) != b.get(k)]
    if differs:
        raise ContractError("runs differ in " + ", ".join(differs))


def compare_runs(a: DataFrame, b: DataFrame, provenance_a: dict, provenance_b: dict, atol: float = 0.0) -> DataFrame:
    """One row: the largest parameter difference of two runs of the same model and data."""
    require_same_provenance(provenance_a, provenance_b)
    compared = compare_tensors(a, b)
    bad = compared.filter("error is not null").orderBy("tensor").limit(10).collect()
    if bad:
        raise ContractError("; ".join(f"{r['tensor']}: {r['error']}" for r in bad))
    return max_difference(compared, atol)


def output_violations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """``relpath, violation`` for restored images that break the output contract.

    Both tables hold ``relpath`` and file profiles (``height, width, src_dtype, min, max,
    error``); no pixels take part in the join.
    """
    left = inputs.select("relpath", F.col("height").alias("_h"), F.col("width").alias("_w"), F.lit(True).alias("_in"))
    right = outputs.select(
        "relpath",
        F.coalesce(
            F.col("error"),
            F.when(F.col("src_dtype") != "float32", F.lit("dtype is not float32")),
            F.when((F.col("min") < 0) | (F.col("max") > 1), F.lit("values outside [0,1]")),
        ).alias("_e"),
        F.col("height").alias("_oh"), F.col("width").alias("_ow"), F.lit(True).alias("_out"),
    )
    both = left.join(right, "relpath", "full_outer")
    violation = F.when(F.col("_out").isNull(), "missing output").when(F.col("_in").isNull(), "unexpected output").otherwise(
        F.coalesce(
            F.col("_e"),
            F.when((F.col("_oh") != 2 * F.col("_h")) | (F.col("_ow") != 2 * F.col("_w")), F.lit("shape is not 2x")),
        )
    )
    return both.select("relpath", violation.alias("violation")).filter("violation is not null")


def verify_outputs(spark: SparkSession, input_dir: str, output_dir: str, expected: int | None = None,
                   artifact: str | None = None, artifact_sha256: str | None = None) -> DataFrame:
    """Violations of a restored directory; empty when every output is valid."""
    sides = []
    for root in (input_dir, output_dir):
        files = list_files(spark, root).filter(~F.col("ignored"))
        require_count(files, expected, f"files under {root}")
        read = spread(files).withColumn("_npy", profile_npy("path"))
        sides.append(read.select("relpath", "_npy.*"))
    if artifact is not None:
        if hashlib.sha256(read_bytes(artifact)).hexdigest() != artifact_sha256:
            raise ContractError("artifact SHA-256 does not match")
    return output_violations(*sides)


def history_report(history: DataFrame, keys=("run",)) -> DataFrame:
    return run_summary(running_best(history, keys), keys)


def latency_report(samples: DataFrame, keys=("run",)) -> DataFrame:
    return latency_summary(samples, keys)
