"""Image columns: each function ships only its own arguments through one Arrow pass.

Images are ``STRUCT<height, width, pixels>``. A scalar Arrow UDF receives the image
columns of a batch, groups the rows by shape, stacks each group without copying where
Arrow's layout allows it, and runs a NumPy kernel on the stack. All other columns stay
in the JVM, so Catalyst can still prune and push filters around the call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..schema import IMAGE_DDL, IMAGE_DOUBLE_DDL, METRICS, METRICS_DDL, TEXTURE_FIELDS
from . import kernels
from .columns import _c


class ImageBatch:
    """NumPy access to one Arrow struct column of images."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.h = column.field("height").fill_null(0).to_numpy(zero_copy_only=False)
        self.w = column.field("width").fill_null(0).to_numpy(zero_copy_only=False)
        pixels = column.field("pixels")
        self.values = pixels.values.to_numpy(zero_copy_only=False)
        self.offsets = pixels.offsets.to_numpy()
        self.valid = np.asarray(column.is_valid()) & np.asarray(pixels.is_valid())

    def groups(self, *others: "ImageBatch"):
        """Yield row indexes of equal shape (in every image column), rows with data only."""
        valid = self.valid.copy()
        for other in others:
            valid &= other.valid
        rows = np.flatnonzero(valid)
        shapes = np.stack([v[rows] for b in (self, *others) for v in (b.h, b.w)], axis=1)
        if len(rows) and (shapes == shapes[0]).all():
            yield rows
            return
        for shape in np.unique(shapes, axis=0):
            yield rows[(shapes == shape).all(axis=1)]

    def stack(self, rows: np.ndarray) -> np.ndarray:
        h, w = int(self.h[rows[0]]), int(self.w[rows[0]])
        size = h * w
        starts = self.offsets[rows]
        if ((self.offsets[rows + 1] - starts) != size).any():
            raise ValueError(f"pixel count differs from shape {h}x{w}")
        if (np.diff(starts) == size).all():
            flat = self.values[starts[0] : starts[0] + size * len(rows)]
            return flat.reshape(len(rows), h, w)
        return np.stack([self.values[s : s + size] for s in starts]).reshape(len(rows), h, w)


def image_array(images: list, dtype=np.float32) -> pa.StructArray:
    """Arrow struct array from a list of 2-D arrays; ``None`` becomes a null image."""
    missing = np.array([im is None for im in images], dtype=bool)
    shapes = np.array([(0, 0) if im is None else im.shape for im in images], dtype=np.int32)
    shapes = shapes.reshape(-1, 2)
    sizes = shapes[:, 0].astype(np.int64) * shapes[:, 1]
    ends = np.cumsum(sizes)
    if len(ends) and ends[-1] > np.iinfo(np.int32).max:
        raise ValueError(f"{ends[-1]} pixels in one Arrow batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    flat = [np.asarray(im, dtype=dtype).ravel() for im in images if im is not None]
    values = np.concatenate(flat) if flat else np.empty(0, dtype)
    pixels = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.StructArray.from_arrays(
        [pa.array(shapes[:, 0]), pa.array(shapes[:, 1]), pixels],
        names=["height", "width", "pixels"],
        mask=pa.array(missing),
    )


def _image_type(dtype: str):
    return (IMAGE_DOUBLE_DDL, np.float64) if dtype == "double" else (IMAGE_DDL, np.float32)


def _doubles(values: np.ndarray, valid: np.ndarray, names) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(values[:, i]) for i in range(values.shape[1])],
        names=list(names),
        mask=pa.array(~valid),
    )


def make_image(height, width, pixels) -> Column:
    """Assemble the image struct from plain columns."""
    return F.struct(
        _c(height).cast("int").alias("height"),
        _c(width).cast("int").alias("width"),
        _c(pixels).alias("pixels"),
    )


def map_images(kernel, dtype: str = "float"):
    """Lift ``stack -> stack`` to an image column function."""
    ddl, np_type = _image_type(dtype)

    @F.arrow_udf(ddl)
    def run(column: pa.Array) -> pa.Array:
        batch = ImageBatch(column)
        out = [None] * len(column)
        for rows in batch.groups():
            for i, image in zip(rows, kernel(batch.stack(rows))):
                out[i] = image
        return image_array(out, np_type)

    return lambda col: run(_c(col))


def resize(col, scale: float = 2.0, mode: str = "bicubic", dtype: str = "float") -> Column:
    """Antialiased bicubic or block-mean area resampling by a fixed factor."""
    if mode not in ("bicubic", "area"):
        raise ValueError(f"unknown resize mode {mode!r}")

    def kernel(x):
        return kernels.resize(x, round(x.shape[1] * scale), round(x.shape[2] * scale), mode)

    return map_images(kernel, dtype)(col)


def gaussian_blur(col, sigma: float, dtype: str = "float") -> Column:
    return map_images(lambda x: kernels.gaussian_blur(x, sigma), dtype)(col)


def _seeded(kernel, dtype: str):
    """Lift ``(image, row index text) -> image`` where the text seeds the row's draws."""
    ddl, np_type = _image_type(dtype)

    @F.arrow_udf(ddl)
    def run(column: pa.Array, key: pa.Array) -> pa.Array:
        batch, keys, out = ImageBatch(column), key.to_pylist(), [None] * len(column)
        for rows in batch.groups():
            for i, image in zip(rows, batch.stack(rows)):
                out[i] = kernel(image, keys[i])
        return image_array(out, np_type)

    return run


def add_noise(col, key, std: float, bias: float = 0.0, seed: int = 2026, dtype="float") -> Column:
    """Additive Gaussian noise plus a constant; draws depend on ``(seed, key)`` only."""

    def kernel(x, k):
        noise = np.random.default_rng(kernels.row_seed(seed, "gaussian", k)).standard_normal(x.shape)
        return x + noise * std + bias

    return _seeded(kernel, dtype)(_c(col), _c(key).cast("string"))


def speckle(col, key, std: float, seed: int = 2026, dtype="float") -> Column:
    """Multiplicative Gaussian noise ``x + x*n*std``."""

    def kernel(x, k):
        noise = np.random.default_rng(kernels.row_seed(seed, "speckle", k)).standard_normal(x.shape)
        return x + x * noise * std

    return _seeded(kernel, dtype)(_c(col), _c(key).cast("string"))


def synthesize(target, key, profile: dict, seed: int = 2026, epoch=0, dtype="float") -> Column:
    """Raw-range synthetic low-resolution observation of a target image."""
    key = F.concat_ws("|", _c(epoch) if isinstance(epoch, Column) else F.lit(str(epoch)), _c(key))

    def kernel(x, k):
        return kernels.synthesize(x, profile, kernels.row_seed(seed, k))

    return _seeded(kernel, dtype)(_c(target), key)


def degrade(target, path, severity, severities: dict, seed: int = 2026, dtype="float") -> Column:
    """Degradation level named by the ``severity`` column, seeded per path and level."""
    ddl, np_type = _image_type(dtype)

    @F.arrow_udf(ddl)
    def run(column: pa.Array, paths: pa.Array, names: pa.Array) -> pa.Array:
        batch, out = ImageBatch(column), [None] * len(column)
        paths, names = paths.to_pylist(), names.to_pylist()
        for rows in batch.groups():
            for i, image in zip(rows, batch.stack(rows)):
                level = severities[names[i]]
                out[i] = kernels.degrade(image, level, kernels.row_seed(seed, names[i], paths[i]))
        return image_array(out, np_type)

    return run(_c(target), _c(path), _c(severity))


def d4(col, transform, dtype: str = "float") -> Column:
    """Dihedral transform 0..7 chosen per row by an integer column or literal."""
    ddl, np_type = _image_type(dtype)

    @F.arrow_udf(ddl)
    def run(column: pa.Array, which: pa.Array) -> pa.Array:
        batch, which, out = ImageBatch(column), which.to_pylist(), [None] * len(column)
        for rows in batch.groups():
            for i, image in zip(rows, batch.stack(rows)):
                if not 0 <= which[i] <= 7:
                    raise ValueError(f"D4 transform must be 0..7, got {which[i]}")
                out[i] = kernels.d4(image, which[i])
        return image_array(out, np_type)

    return run(_c(col), transform if isinstance(transform, Column) else F.lit(transform))


def _per_image(kernel, names):
    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def run(column: pa.Array) -> pa.Array:
        batch = ImageBatch(column)
        values, valid = np.zeros((len(column), len(names))), np.zeros(len(column), bool)
        for rows in batch.groups():
            values[rows], valid[rows] = kernel(batch.stack(rows)), True
        return _doubles(values, valid, names)

    return run


def _per_pair(kernel, names):
    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = ImageBatch(left), ImageBatch(right)
        values, valid = np.zeros((len(left), len(names))), np.zeros(len(left), bool)
        for rows in a.groups(b):
            values[rows], valid[rows] = kernel(a.stack(rows), b.stack(rows)), True
        return _doubles(values, valid, names)

    return run


def _check_finite(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("image contains NaN or infinity")
    return x


def texture_descriptor(col) -> Column:
    """Struct of the eleven texture statistics."""
    return _per_image(lambda x: kernels.texture_descriptor(_check_finite(x)), TEXTURE_FIELDS)(_c(col))


def image_statistics(col) -> Column:
    """Struct of min, max, mean, std: one Arrow pass for large images."""

    def kernel(x):
        flat = x.reshape(len(x), -1).astype(np.float64)
        return np.stack([flat.min(1), flat.max(1), flat.mean(1), flat.std(1)], axis=1)

    return _per_image(kernel, ("min", "max", "mean", "std"))(_c(col))


RESIDUAL_FIELDS = ("residual_std", "residual_mean", "speckle_mad", "blur_proxy")


def residual_features(degraded, target) -> Column:
    return _per_pair(kernels.residual_features, RESIDUAL_FIELDS)(_c(degraded), _c(target))


def _pair_kernel(fn):
    def kernel(p, t):
        if p.shape != t.shape:
            raise ValueError(f"shape mismatch: {p.shape[1:]} vs {t.shape[1:]}")
        return fn(np.clip(p, 0, 1), np.clip(t, 0, 1))[:, None]

    return kernel


def ssim(prediction, target) -> Column:
    return _per_pair(_pair_kernel(kernels.ssim), ("v",))(_c(prediction), _c(target))["v"]


def sobel_l1(prediction, target) -> Column:
    return _per_pair(_pair_kernel(kernels.sobel_l1), ("v",))(_c(prediction), _c(target))["v"]


def check_prediction(prediction: np.ndarray, expected: tuple) -> np.ndarray:
    """Prediction contract: exactly the expected stack shape, every value finite."""
    if prediction.shape != expected:
        raise ValueError(f"predictor returned shape {prediction.shape}, expected {expected}")
    if not np.isfinite(prediction).all():
        raise ValueError("predictor produced NaN or infinity")
    return prediction


def metrics_array(scored: list, n: int) -> pa.StructArray:
    """Arrow metric structs from ``(rows, metric dict, prediction shape, target shape)``."""
    values = {m: np.full(n, np.nan) for m in METRICS}
    perceptual_seen = np.zeros(n, bool)
    shapes = np.full((n, 2), None, dtype=object)
    valid = np.zeros(n, bool)
    for rows, found, p_shape, t_shape in scored:
        for name, vector in found.items():
            values[name][rows] = vector
        perceptual_seen[rows] = "lpips_alex" in found
        shapes[rows] = ["x".join(map(str, p_shape)), "x".join(map(str, t_shape))]
        valid[rows] = True
    columns = [
        pa.array(values[m], mask=~perceptual_seen if m == "lpips_alex" else None) for m in METRICS
    ] + [pa.array(shapes[:, 0], pa.string()), pa.array(shapes[:, 1], pa.string())]
    names = list(METRICS) + ["prediction_shape", "target_shape"]
    return pa.StructArray.from_arrays(columns, names=names, mask=pa.array(~valid))


def _perceptual_planes(x: np.ndarray) -> np.ndarray:
    scaled = np.clip(x, 0, 1).astype(np.float32) * 2 - 1
    return np.repeat(scaled[:, None], 3, axis=1)


def score_stack(raw, target, perceptual=None) -> dict:
    """Metrics of one stack; ``perceptual(p, t, normalize=False)`` fills ``lpips_alex``."""
    if raw.shape != target.shape:
        raise ValueError(f"shape mismatch: {raw.shape[1:]} vs {target.shape[1:]}")
    found = kernels.image_metrics(_check_finite(raw), _check_finite(target))
    if perceptual is not None:
        found["lpips_alex"] = np.asarray(
            perceptual(_perceptual_planes(raw), _perceptual_planes(target), normalize=False), float
        ).reshape(-1)
    return found


def image_metrics(prediction, target, perceptual=None) -> Column:
    """All metrics of one prediction/target pair as a struct; ``lpips_alex`` may be NULL."""

    @F.arrow_udf(METRICS_DDL)
    def run(pred: pa.Array, targ: pa.Array) -> pa.Array:
        p, t = ImageBatch(pred), ImageBatch(targ)
        scored = []
        for rows in p.groups(t):
            x, y = p.stack(rows), t.stack(rows)
            scored.append((rows, score_stack(x, y, perceptual), x.shape[1:], y.shape[1:]))
        return metrics_array(scored, len(pred))

    return run(_c(prediction), _c(target))


def perceptual_distance(prediction, target, scorer) -> Column:
    """Only the user-supplied perceptual distance."""

    def kernel(p, t):
        planes = _perceptual_planes(p), _perceptual_planes(t)
        return np.asarray(scorer(*planes, normalize=False), float).reshape(-1, 1)

    return _per_pair(kernel, ("v",))(_c(prediction), _c(target))["v"]
