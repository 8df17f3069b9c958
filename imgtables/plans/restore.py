"""Batch restoration, the learned residual restorer and report panels."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.imaging import ImageBatch
from ..functions.restoring import Bicubic, Residual, patch_features, predict, restore_files, score
from ..operators.checks import require_count, require_train, require_unique
from ..operators.selection import worst_k
from ..sinks import guard_nested, guard_output, write_json
from ..sources import scan_npy
from ..sources.npy_source import Staging


def restore(spark: SparkSession, input_dir: str, output_dir: str, predictor=None, overwrite: bool = False,
            expected: int | None = None, report_path: str | None = None) -> dict:
    """Restore every array file of a directory to the same relative path; returns a report.

    File names are the only rows Spark moves: each task reads, restores, checks, clips
    and writes its own files. They appear together when all are written; a failed job
    leaves nothing.
    """
    predictor = predictor or Bicubic()
    files = require_unique(scan_npy(spark, input_dir))
    require_count(files, expected, "inputs")
    guard_nested(input_dir, output_dir)
    guard_output(output_dir, overwrite)
    started = time.perf_counter()
    with Staging(output_dir, overwrite) as staged:
        written = files.select(restore_files("path", "relpath", predictor, staged).alias("w"))
        total = written.agg(F.count("w.sha256").alias("n"), F.sum("w.bytes").alias("bytes")).first()
    elapsed = time.perf_counter() - started
    report = {
        "model": getattr(predictor, "name", type(predictor).__name__),
        "input_count": total["n"],
        "output_bytes": total["bytes"],
        "elapsed_seconds": elapsed,
        "mean_milliseconds_per_image": elapsed * 1000.0 / total["n"],
    }
    if report_path:
        write_json(report, report_path, overwrite)
    return report


FEATURE_PIXELS = 1 << 17  # pixels whose neighbourhoods are held at a time


def _normal_equations(patch: int, teacher_weight: float, teacher):
    size = patch * patch + 1
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches):
        total = np.zeros((size, size + 4))
        seen = False
        for batch in batches:
            low, high = ImageBatch(batch.column(0)), ImageBatch(batch.column(1))
            for rows in low.groups(high):
                x, y = low.stack(rows).astype(np.float64), high.stack(rows).astype(np.float64)
                if y.shape[1:] != (2 * x.shape[1], 2 * x.shape[2]):
                    raise ValueError("target is not 2x the input")
                if teacher is not None:
                    y = (1 - teacher_weight) * y + teacher_weight * teacher(x)
                gap = y - Bicubic()(x)
                n, h, w = x.shape
                planes = gap.reshape(n, h, 2, w, 2).transpose(0, 1, 3, 2, 4).reshape(n, h * w, 4)
                step = max(1, FEATURE_PIXELS // (h * w))
                for start in range(0, n, step):  # the feature matrix does not grow with the batch
                    features = patch_features(x[start:start + step], patch)
                    total[:, :size] += features.T @ features
                    total[:, size:] += features.T @ planes[start:start + step].reshape(-1, 4)
                seen = True
        if seen:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                schema=schema,
            )

    return run


def fit_residual_restorer(pairs: DataFrame, patch: int = 5, ridge: float = 1e-3, split: str = "train",
                          teacher=None, teacher_weight: float = 0.0, input_col: str = "input",
                          target_col: str = "target", statistics: DataFrame | None = None):
    """``(predictor, statistics)``: ridge regression of the residual over bicubic.

    Each task adds up its own normal equations; Spark sums ``(patch^2+1) x (patch^2+5)``
    cells and only those reach the driver. ``statistics`` of an earlier fit are added, so
    training can continue with new rows alone. Honour augmentation by passing the output
    of ``materialize_training``.
    """
    if teacher is not None and not 0.0 < teacher_weight <= 1.0:
        raise ContractError("teacher_weight must be in (0, 1]")
    rows = require_train(pairs, split) if "split" in pairs.columns else pairs
    part = rows.select(input_col, target_col).mapInArrow(
        _normal_equations(patch, teacher_weight, teacher), "i int, j int, value double"
    )
    if statistics is not None:
        part = part.unionByName(statistics)
    cells = part.groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = cells.collect()  # (patch^2+1) x (patch^2+5) cells, whatever the data size
    if not found:
        raise ContractError("no training pairs")
    size = patch * patch + 1
    total = np.zeros((size, size + 4))
    for r in found:
        total[r["i"], r["j"]] = r["value"]
    gram = total[:, :size] + ridge * total[size - 1, size - 1] * np.eye(size)
    weights = np.linalg.solve(gram, total[:, size:])
    summed = rows.sparkSession.createDataFrame([(r["i"], r["j"], r["value"]) for r in found], cells.schema)
    return Residual(weights, patch), summed


def validate_predictor(pairs: DataFrame, predictor, input_col: str = "input", target_col: str = "target") -> float:
    """Mean PSNR with the error floored at 1e-12, as used while training."""
    psnr = score(input_col, target_col, predictor)["psnr_db"]
    return pairs.select(psnr.alias("p")).agg(F.avg(F.least("p", F.lit(120.0)))).first()[0]


def panel_rows(metrics: DataFrame, pairs: DataFrame, k: int, predictor, metric: str = "psnr_db",
               dtype: str = "float") -> DataFrame:
    """The ``k`` worst rows with input, bicubic, restored and target images."""
    worst = F.broadcast(worst_k(metrics.select("stem", metric), k, metric))  # k rows
    picked = pairs.join(worst, "stem")
    return picked.select(
        "stem", metric, "input",
        predict("input", Bicubic(), dtype).alias("bicubic"),
        predict("input", predictor, dtype).alias("restored"),
        "target",
    )
