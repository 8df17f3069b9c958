"""Predictors and the fused predict-and-score passes built around them.

A predictor is any callable ``[N, H, W] -> [N, 2H, 2W]``. Pixels cross into Python once:
prediction, contract check, clipping, scoring or writing all happen in the same batch.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..schema import IMAGE_DDL, IMAGE_DOUBLE_DDL, METRICS, METRICS_DDL
from ..sources.images import read_bytes, read_npy
from ..sources.listing import open_fs
from . import kernels
from .columns import _c
from .imaging import ImageBatch, check_prediction, image_array, metrics_array, score_stack

FORMAT_VERSION = 1


class Bicubic:
    """Parameter-free 2x upsampling."""

    name, config = "bicubic", {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernels.resize_bicubic(x, 2 * x.shape[1], 2 * x.shape[2])


class Residual:
    """Bicubic plus a linear residual of the surrounding input patch, per output sub-pixel."""

    name = "residual"

    def __init__(self, weights, patch: int = 5):
        if patch < 1 or patch % 2 == 0:
            raise ContractError("patch must be odd and positive")
        self.config = {"patch": patch}
        self.weights = np.asarray(weights, dtype=np.float64).reshape(patch * patch + 1, 4)
        self.patch = patch

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n, h, w = x.shape
        planes = patch_features(x, self.patch) @ self.weights.astype(x.dtype)
        residual = kernels.pixel_shuffle(planes.reshape(n, h, w, 4).transpose(0, 3, 1, 2))
        return Bicubic()(x) + residual


def patch_features(x: np.ndarray, patch: int) -> np.ndarray:
    """``[N*H*W, patch^2 + 1]``: each pixel's neighbourhood (edges repeated) and a one."""
    r = patch // 2
    padded = np.pad(x, ((0, 0), (r, r), (r, r)), mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (patch, patch), axis=(1, 2))
    flat = windows.reshape(-1, patch * patch)
    return np.concatenate([flat, np.ones((len(flat), 1), x.dtype)], axis=1)


# Configuration fields each built-in predictor accepts.
PREDICTOR_FIELDS = {"bicubic": frozenset(), "residual": frozenset({"patch"})}


def create_predictor(name: str, config: dict | None = None, weights=None):
    """Build a predictor by name; unknown names and configuration fields are errors."""
    config = config or {}
    if name not in PREDICTOR_FIELDS:
        raise ContractError(f"unsupported predictor: {name}")
    unknown = sorted(set(config) - PREDICTOR_FIELDS[name])
    if unknown:
        raise ContractError(f"unknown {name} configuration field(s): {unknown}")
    return Bicubic() if name == "bicubic" else Residual(weights, **config)


class PerWorker:
    """A predictor built once in each Python worker by ``factory()``, for large models."""

    _built: dict = {}

    def __init__(self, factory):
        self.factory, self.token = factory, uuid.uuid4().hex

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.token not in PerWorker._built:
            PerWorker._built[self.token] = self.factory()
        return PerWorker._built[self.token](x)


# --- model table ---------------------------------------------------------------------

MODEL_DDL = (
    "format_version int, name string, config string, weights array<double>, sha256 string, "
    "provenance map<string,string>"
)


def _weights_digest(name: str, config: str, weights) -> str:
    body = np.asarray(weights, dtype="<f8").tobytes()
    return hashlib.sha256(f"{name}\n{config}\n".encode() + body).hexdigest()


def model_table(spark: SparkSession, predictor, provenance: dict | None = None) -> DataFrame:
    """Self-describing one-row model artifact; write it as Parquet."""
    config = json.dumps(predictor.config, sort_keys=True)
    weights = [float(v) for v in np.ravel(getattr(predictor, "weights", []))]
    row = (FORMAT_VERSION, predictor.name, config, weights,
           _weights_digest(predictor.name, config, weights), provenance or {})
    return spark.createDataFrame([row], MODEL_DDL)


def load_model(table: DataFrame):
    """``(predictor, provenance)`` from a model table; every field is checked."""
    rows = table.limit(2).collect()
    if len(rows) != 1 or set(table.columns) < {"format_version", "name", "config", "weights", "sha256"}:
        raise ContractError("a model artifact is exactly one complete row")
    row = rows[0]
    if row["format_version"] != FORMAT_VERSION:
        raise ContractError(f"unsupported model format {row['format_version']}")
    if _weights_digest(row["name"], row["config"], row["weights"]) != row["sha256"]:
        raise ContractError("model content does not match its SHA-256")
    return create_predictor(row["name"], json.loads(row["config"]), row["weights"]), row["provenance"]


# --- fused passes ----------------------------------------------------------------------


def run_predictor(predictor, x: np.ndarray) -> np.ndarray:
    return check_prediction(np.asarray(predictor(x)), (len(x), 2 * x.shape[1], 2 * x.shape[2]))


def predict(image, predictor, dtype: str = "float", clip: bool = False) -> Column:
    """Restored image column; raw range unless ``clip``."""
    ddl, np_type = (IMAGE_DOUBLE_DDL, np.float64) if dtype == "double" else (IMAGE_DDL, np.float32)

    @F.arrow_udf(ddl)
    def run(column: pa.Array) -> pa.Array:
        batch, out = ImageBatch(column), [None] * len(column)
        for rows in batch.groups():
            result = run_predictor(predictor, batch.stack(rows))
            for i, restored in zip(rows, np.clip(result, 0, 1) if clip else result):
                out[i] = restored
        return image_array(out, np_type)

    return run(_c(image))


def score(image, target, predictor, perceptual=None) -> Column:
    """Predict and score in one pass; the prediction never returns to the JVM."""

    @F.arrow_udf(METRICS_DDL)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b, scored = ImageBatch(left), ImageBatch(right), []
        for rows in a.groups(b):
            raw, goal = run_predictor(predictor, a.stack(rows)), b.stack(rows)
            scored.append((rows, score_stack(raw, goal, perceptual), raw.shape[1:], goal.shape[1:]))
        return metrics_array(scored, len(left))

    return run(_c(image), _c(target))


def _load(path: str) -> np.ndarray:
    array, _, error = read_npy(read_bytes(path))
    if error:
        raise ContractError(f"{path}: {error}")
    return array


def _same_shape(*lists):
    """Row indexes grouped by the shapes of every list's array at that row."""
    groups: dict = {}
    for i, arrays in enumerate(zip(*lists)):
        groups.setdefault(tuple(a.shape for a in arrays), []).append(i)
    return groups.values()


def score_files(input_path, target_path, predictor, perceptual=None) -> Column:
    """:func:`score` on file paths: both files of a pair are read by the scoring task."""

    @F.arrow_udf(METRICS_DDL)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        scored, lefts, rights = [], left.to_pylist(), right.to_pylist()
        for at in range(0, len(lefts), 64):
            inputs = [_load(p) for p in lefts[at : at + 64]]
            goals = [_load(p) for p in rights[at : at + 64]]
            for rows in _same_shape(inputs, goals):
                raw = run_predictor(predictor, np.stack([inputs[i] for i in rows]))
                goal = np.stack([goals[i] for i in rows])
                found = score_stack(raw, goal, perceptual)
                scored.append((np.array(rows) + at, found, raw.shape[1:], goal.shape[1:]))
        return metrics_array(scored, len(lefts))

    return run(_c(input_path), _c(target_path))


GRID_DDL = "array<struct<severity:string,method:string," + ",".join(f"{m}:double" for m in METRICS) + ">>"


def score_grid(image, path, severities: dict, predictors: dict, seed: int = 2026, perceptual=None) -> Column:
    """Scores of every severity and method for one reference image, from one decode."""

    @F.arrow_udf(GRID_DDL)
    def run(column: pa.Array, paths: pa.Array) -> pa.Array:
        batch, names = ImageBatch(column), paths.to_pylist()
        out = [[] for _ in names]
        for rows in batch.groups():
            goal = batch.stack(rows)
            for severity, level in severities.items():
                low = np.stack([
                    kernels.degrade(g, level, kernels.row_seed(seed, severity, names[i]))
                    for i, g in zip(rows, goal)
                ])
                for method, predictor in predictors.items():
                    found = score_stack(run_predictor(predictor, low), goal, perceptual)
                    for k, i in enumerate(rows):
                        values = {m: float(found[m][k]) if m in found else None for m in METRICS}
                        out[i].append({"severity": severity, "method": method, **values})
        kind = pa.list_(pa.struct([("severity", pa.string()), ("method", pa.string())]
                                  + [(m, pa.float64()) for m in METRICS]))
        return pa.array(out, type=kind)

    return run(_c(image), _c(path))


def npy_bytes(array: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, np.ascontiguousarray(array, dtype=np.float32), allow_pickle=False)
    return buffer.getvalue()


def write_bytes(path: str, content: bytes) -> None:
    """Write beside the target, then rename: a retried or doubled task changes nothing.

    A folder is created when the first file of it fails for want of one.
    """
    fs, at = open_fs(path)
    folder, _, name = at.rpartition("/")
    renames = isinstance(fs, (pafs.LocalFileSystem, pafs.HadoopFileSystem))
    target = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp" if renames else at  # object stores publish on close
    try:
        stream = fs.open_output_stream(target)
    except FileNotFoundError:
        fs.create_dir(folder, recursive=True)
        stream = fs.open_output_stream(target)
    with stream:
        stream.write(content)
    if renames:
        fs.move(target, at)


WRITTEN_DDL = "struct<height:int,width:int,bytes:bigint,sha256:string>"


def _written(rows: list) -> pa.Array:
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("bytes", pa.int64()), ("sha256", pa.string())])
    return pa.array(rows, type=kind)


def _write_one(root: str, relpath: str, array: np.ndarray) -> dict:
    content = npy_bytes(array)
    write_bytes(f"{root}/{relpath}", content)
    return {"height": array.shape[0], "width": array.shape[1], "bytes": len(content),
            "sha256": hashlib.sha256(content).hexdigest()}


def write_image(image, relpath, root: str) -> Column:
    """Side effect column: store the image as ``root/relpath`` and describe what was written."""

    @F.arrow_udf(WRITTEN_DDL)
    def run(column: pa.Array, paths: pa.Array) -> pa.Array:
        batch, names, out = ImageBatch(column), paths.to_pylist(), [None] * len(column)
        for rows in batch.groups():
            for i, array in zip(rows, batch.stack(rows)):
                out[i] = _write_one(root, names[i], array)
        return _written(out)

    return run.asNondeterministic()(_c(image), _c(relpath))


def restore_files(path, relpath, predictor, root: str) -> Column:
    """Read, restore, check, clip and write array files without returning pixels to the JVM."""

    @F.arrow_udf(WRITTEN_DDL)
    def run(sources: pa.Array, paths: pa.Array) -> pa.Array:
        sources, names = sources.to_pylist(), paths.to_pylist()
        out = [None] * len(names)
        for at in range(0, len(names), 64):
            arrays = [_load(p) for p in sources[at : at + 64]]
            for rows in _same_shape(arrays):
                restored = run_predictor(predictor, np.stack([arrays[i] for i in rows]))
                for i, image in zip(rows, np.clip(restored, 0, 1)):
                    out[at + i] = _write_one(root, names[at + i], image)
        return _written(out)

    return run.asNondeterministic()(_c(path), _c(relpath))
