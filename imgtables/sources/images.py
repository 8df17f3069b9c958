"""Image sources: ``.npy`` arrays and JPEG files, decoded inside tasks."""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.columns import _c, basename, parent_name
from ..functions.imaging import image_array
from ..functions.pixels import image_error
from ..schema import DECODED_DDL, IMAGE_DDL
from .listing import list_files, open_fs, spread, uri_prefix


def scan_npy(spark: SparkSession, root: str) -> DataFrame:
    """The real ``.npy`` files under ``root``, evenly spread over tasks."""
    return spread(list_files(spark, root).filter(~F.col("ignored")))


def read_npy(content: bytes):
    """Decode one file: ``(array | None, dtype, error | None)``; range is never changed."""
    try:
        array = np.load(io.BytesIO(content), allow_pickle=False)
    except Exception as exc:  # several format-specific exceptions are possible
        return None, None, f"could not load array: {exc}"
    dtype = str(getattr(array, "dtype", None))
    if not isinstance(array, np.ndarray):
        return None, dtype, "not an array file"
    if array.ndim != 2:
        return None, dtype, f"expected a 2-D array, got shape {array.shape}"
    if array.size == 0:
        return None, dtype, "empty image"
    real = np.issubdtype(array.dtype, np.number) and not np.iscomplexobj(array)
    if not real:
        return None, dtype, f"expected a real numeric array, got {dtype}"
    if not np.isfinite(array).all():
        return None, dtype, "contains NaN or infinity"
    return np.ascontiguousarray(array, dtype=np.float32), dtype, None


def read_bytes(path: str) -> bytes:
    fs, at = open_fs(path)
    with fs.open_input_stream(at) as stream:
        return stream.read()


def _decode(contents: list) -> pa.StructArray:
    images, dtypes, digests, errors = [], [], [], []
    for content in contents:
        array, dtype, error = read_npy(content)
        images.append(array)
        dtypes.append(dtype)
        errors.append(error)
        digests.append(hashlib.sha256(content).hexdigest())
    return pa.StructArray.from_arrays(
        [image_array(images), pa.array(dtypes, pa.string()), pa.array(digests, pa.string()),
         pa.array(errors, pa.string())],
        names=["image", "src_dtype", "sha256", "error"],
    )


def load_npy(path) -> Column:
    """Struct ``image, src_dtype, sha256, error`` of the array file a path names.

    Marked non-deterministic so that a filter on the result never reads a file twice.
    """

    @F.arrow_udf(DECODED_DDL)
    def run(paths: pa.Array) -> pa.Array:
        return _decode([read_bytes(p) for p in paths.to_pylist()])

    return run.asNondeterministic()(_c(path))


PROFILE_DDL = (
    "struct<height:int,width:int,src_dtype:string,min:double,max:double,mean:double,std:double,"
    "sha256:string,error:string>"
)


def profile_npy(path) -> Column:
    """Shape, statistics and digest of the array file a path names; no pixels leave the task."""

    def one(content: bytes) -> dict:
        array, dtype, error = read_npy(content)
        row = {"src_dtype": dtype, "sha256": hashlib.sha256(content).hexdigest(), "error": error}
        if array is not None:
            wide = array.astype(np.float64)
            row.update(height=array.shape[0], width=array.shape[1], min=float(wide.min()), max=float(wide.max()),
                       mean=float(wide.mean()), std=float(wide.std()))
        return row

    @F.arrow_udf(PROFILE_DDL)
    def run(paths: pa.Array) -> pa.Array:
        kinds = [("height", pa.int32()), ("width", pa.int32()), ("src_dtype", pa.string())]
        kinds += [(n, pa.float64()) for n in ("min", "max", "mean", "std")]
        kinds += [("sha256", pa.string()), ("error", pa.string())]
        return pa.array([one(read_bytes(p)) for p in paths.to_pylist()], pa.struct(kinds))

    return run.asNondeterministic()(_c(path))


def decode_npy(files: DataFrame) -> DataFrame:
    """Replace nothing, add ``image, src_dtype, sha256, error`` to a file listing."""
    loaded = files.withColumn("_npy", load_npy("path"))
    return loaded.select(*files.columns, "_npy.*")


def load_pairs(pairs: DataFrame, scale: int = 2) -> DataFrame:
    """Decode the files of ``read_pairs`` rows into ``input`` and ``target`` image columns.

    Both files of a pair are read by the task that holds its names. A bad file or a pair
    of the wrong shapes raises there.
    """
    read = pairs.withColumn("_i", load_npy("input_path")).withColumn("_t", load_npy("target_path"))
    h, w = F.col("_i.image.height"), F.col("_i.image.width")
    wrong = (F.col("_t.image.height") != scale * h) | (F.col("_t.image.width") != scale * w)
    error = F.coalesce(F.col("_i.error"), F.col("_t.error"), F.when(wrong, F.lit(f"target is not {scale}x the input")))

    def checked(column):
        message = F.concat_ws(": ", "stem", error)
        return F.when(error.isNull(), F.col(f"{column}.image")).otherwise(F.raise_error(message))

    keep = [c for c in pairs.columns if not c.endswith("_path")]
    return read.select(*keep, checked("_i").alias("input"), checked("_t").alias("target"))


def validate_images(images: DataFrame, mode: str = "fail", name_col: str = "relpath") -> DataFrame:
    """Apply the image contract.

    ``fail`` decides in one pass of its own before anything downstream runs and names the
    offenders; ``assert`` raises inside the task that meets the first one, so files are
    decoded only once; ``quarantine`` keeps bad rows with ``error`` set.
    """
    found = image_error("image.height", "image.width", "image.pixels")
    checked = images.withColumn(
        "error", F.coalesce(F.col("error"), found) if "error" in images.columns else found
    )
    return _settle(checked, mode, name_col)


def _settle(checked: DataFrame, mode: str, name_col: str) -> DataFrame:
    """Turn an ``error`` column into the behaviour of a validation mode."""
    if mode == "quarantine":
        return checked
    if mode == "assert":
        message = F.concat_ws(": ", name_col, "error")
        image = F.when(F.col("error").isNull(), F.col("image")).otherwise(F.raise_error(message))
        return checked.withColumn("image", image).drop("error")
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")
    bad = checked.filter(F.col("error").isNotNull()).select(name_col, "error")
    first = bad.orderBy(name_col).limit(10).collect()
    if first:
        raise ContractError("invalid image(s): " + "; ".join(f"{r[0]}: {r[1]}" for r in first))
    return checked.drop("error")


# --- JPEG ----------------------------------------------------------------------


def _gray_stack(image: pa.Array) -> pa.Array:
    heights, widths, channels = (
        image.field(n).to_pylist() for n in ("height", "width", "nChannels")
    )
    out = []
    for h, w, c, data in zip(heights, widths, channels, image.field("data")):
        if h is None or h < 1 or c not in (1, 3, 4):
            out.append(None)
            continue
        raw = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(h, w, c)
        if c == 1:
            gray = raw[..., 0]
        else:
            # ITU-R 601 luma in 16-bit fixed point, channels stored B, G, R.
            b, g, r = (raw[..., k].astype(np.uint32) for k in range(3))
            gray = (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16
        out.append(gray.astype(np.float32) / np.float32(255))
    return image_array(out)


def to_gray(image) -> Column:
    """Grayscale image of a column read by Spark's ``image`` source."""

    @F.arrow_udf(IMAGE_DDL)
    def run(column: pa.Array) -> pa.Array:
        return _gray_stack(column)

    return run(_c(image))


def scan_jpeg(spark: SparkSession, root: str) -> DataFrame:
    """Grayscale ``[0, 1]`` images of all ``.jpg``/``.jpeg`` files, decoded by Spark."""
    listed = list_files(spark, root, suffixes=(".jpg", ".jpeg"), ignore_case=True)
    hidden = listed.filter("relpath rlike '(^|/)[._]'").limit(10).collect()
    if hidden:
        names = ", ".join(r["relpath"] for r in hidden)
        raise ContractError(f"the image source cannot see hidden names, rename them: {names}")
    _, base = open_fs(root)
    marker = uri_prefix(root) + base.rstrip("/") + "/"
    images = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG]}")
        .load(root)
    )
    origin = F.col("image.origin")
    relpath = F.substr(origin, F.instr(origin, marker) + len(marker))
    return images.select(
        relpath.alias("relative_path"),
        basename(relpath).alias("name"),
        parent_name(relpath).alias("defect_group"),
        to_gray("image").alias("image"),
    )


def require_even(images: DataFrame, min_side: int = 12, mode: str = "fail",
                 name_col: str = "relative_path") -> DataFrame:
    """Decoded images with even sides of at least ``min_side`` pixels; modes as above."""
    h, w = F.col("image.height"), F.col("image.width")
    error = F.when(F.col("image").isNull(), F.lit("could not decode")).when(
        (F.least(h, w) < min_side) | (h % 2 != 0) | (w % 2 != 0),
        F.lit(f"expected even sides of at least {min_side}"),
    )
    return _settle(images.withColumn("error", error), mode, name_col)
