"""Column expressions that need no pixels: paths, text, digests, schedules, predicates."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import LOWER_IS_BETTER


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- paths -----------------------------------------------------------------


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path) -> Column:
    """Name of the containing directory; empty at the top level."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def is_archive_noise(relpath) -> Column:
    """Archive by-products: any ``__MACOSX`` part, or a ``._`` base name."""
    return F.array_contains(F.split(_c(relpath), "/"), "__MACOSX") | basename(relpath).startswith("._")


def with_path_parts(df: DataFrame, path_col: str, root: str) -> DataFrame:
    """Add ``relpath``, ``name``, ``stem`` and ``parent`` for a path under ``root``."""
    prefix = root.rstrip("/") + "/"
    rel = F.when(
        F.col(path_col).startswith(prefix), F.substr(F.col(path_col), F.lit(len(prefix) + 1))
    ).otherwise(F.col(path_col))
    return (
        df.withColumn("relpath", rel)
        .withColumn("name", basename("relpath"))
        .withColumn("stem", stem("relpath"))
        .withColumn("parent", parent_name("relpath"))
    )


def _texts(values: pa.Array, fn) -> pa.Array:
    return pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _casefold(values: pa.Array) -> pa.Array:
    return _texts(values, str.casefold)


def casefold_key(col) -> Column:
    """Full Unicode case folding (``lower`` differs, for example on sharp s)."""
    return _casefold(_c(col))


def path_error(col) -> Column:
    """NULL for a safe relative path, else the reason it is refused.

    A path escapes if it ever climbs above its root, counted step by step without the parts
    that name the same folder.
    """
    text = F.coalesce(_c(col), F.lit(""))
    steps = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    # depth so far and how far it has ever been below zero; a climb above the root stays above it
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("above")),
        lambda s, p: F.when(p != "..", F.struct((s["depth"] + 1).alias("depth"), s["above"].alias("above")))
        .when(s["depth"] > 0, F.struct((s["depth"] - 1).alias("depth"), s["above"].alias("above")))
        .otherwise(F.struct(s["depth"].alias("depth"), (s["above"] + 1).alias("above"))),
    )
    return (
        F.when(text.startswith("/"), "path must be relative")
        .when(walk["above"] > 0, "path escapes the dataset root")
        .when(walk["depth"] == 0, "path is empty")
    )


# --- text and digests --------------------------------------------------------


def shape_text(height, width) -> Column:
    return F.concat_ws("x", _c(height).cast("string"), _c(width).cast("string"))


@F.arrow_udf(T.StringType())
def _number_text(values: pa.Array) -> pa.Array:
    return _texts(values, lambda v: format(v, ".10g"))


def number_text(col) -> Column:
    """Ten significant digits without padding; blank stays NULL. For text sinks only."""
    return _number_text(_c(col).cast("double"))


def content_sha256(col) -> Column:
    return F.sha2(_c(col).cast("binary"), 256)


def rank_key(stem_col, seed: int, tag: str | None = None) -> Column:
    """Seeded hash whose hex order ranks rows the same way under any partitioning."""
    prefix = f"{seed}:" if tag is None else f"{seed}:{tag}:"
    return F.sha2(F.concat(F.lit(prefix), _c(stem_col)).cast("binary"), 256)


def hash_uniform(text) -> Column:
    """Deterministic draw in [0, 1) from the first 8 hex digits of an MD5."""
    digits = F.substring(F.md5(_c(text).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def cluster_label(col) -> Column:
    return F.format_string("texture_%02d", _c(col).cast("int"))


def label_or_unassigned(col) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(col)), F.lit("")), F.lit("unassigned"))


# --- numeric -----------------------------------------------------------------


def is_finite(col) -> Column:
    """True for a present, finite number; NULL, NaN and infinities give False."""
    value = _c(col).cast("double")
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) != F.lit(math.inf)), F.lit(False)
    )


def lr_factor(step, max_steps: int, warmup_steps: int) -> Column:
    """Linear warm-up followed by one cosine half-wave down to zero."""
    s = _c(step).cast("double")
    span = float(max(1, max_steps - warmup_steps))
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - F.lit(float(warmup_steps))) / F.lit(span)))
    cosine = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress))
    if warmup_steps <= 0:
        return cosine
    return F.when(s < warmup_steps, (s + 1.0) / F.lit(float(warmup_steps))).otherwise(cosine)


def is_scale_pair(scale: int = 2, input_prefix: str = "in", target_prefix: str = "tg") -> Column:
    """Target height and width are exactly ``scale`` times the input's."""
    return (F.col(f"{target_prefix}_h") == scale * F.col(f"{input_prefix}_h")) & (
        F.col(f"{target_prefix}_w") == scale * F.col(f"{input_prefix}_w")
    )


def better(metric: str, candidate, baseline) -> Column:
    """Strict win in the metric's own direction; ties are not wins."""
    a, b = _c(candidate), _c(baseline)
    return a < b if metric in LOWER_IS_BETTER else a > b


def select_weights(raw, ema) -> Column:
    """Pick the better of two scores by name; a tie or missing EMA keeps ``raw``."""
    return (
        F.when(_c(raw).isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(_c(ema) > _c(raw), F.lit(False)), F.lit("ema"))
        .otherwise(F.lit("raw"))
    )


def nearest_upsample_index(width: int, scale: int = 2):
    """Row-major source index of output pixel ``p`` under nearest upsampling."""

    def index(p: Column) -> Column:
        out_w = width * scale
        y = F.floor(p / out_w / scale).cast("int")
        x = F.floor((p % out_w) / scale).cast("int")
        return y * width + x

    return index
