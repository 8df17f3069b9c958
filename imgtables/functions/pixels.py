"""Pixel reductions and maps as JVM-side array expressions.

These read ``ARRAY<FLOAT|DOUBLE>`` columns without leaving the JVM and suit short arrays
and single reductions. Jobs that need several pixel quantities at once use the fused
Arrow kernels in :mod:`imgtables.functions.imaging` instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .columns import _c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst may inline a column's expression into the place that reads it. Inside an
    element-wise lambda that would repeat the whole expression for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(pixels: Column, value=lambda x: x) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda acc, x: acc + value(x.cast("double")))


def _mean(pixels: Column, value=lambda x: x) -> Column:
    return _sum(pixels, value) / F.size(pixels)


def all_finite(pixels) -> Column:
    return ~F.exists(_c(pixels), lambda x: F.isnan(x) | (F.abs(x) == F.lit(math.inf)))


def image_error(height, width, pixels) -> Column:
    """NULL when the image keeps the contract, else the reason it does not."""
    h, w, px = _c(height), _c(width), _c(pixels)
    return (
        F.when(px.isNull() | h.isNull() | w.isNull(), F.lit("not a 2-D real array"))
        .when((h < 1) | (w < 1) | (F.size(px) == 0), F.lit("empty image"))
        .when(F.size(px) != h * w, F.lit("pixel count differs from shape"))
        .when(~all_finite(px), F.lit("contains NaN or infinity"))
    )


def clamp01(pixels) -> Column:
    return F.transform(_c(pixels), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))


def image_stats(pixels) -> Column:
    """Struct of min, max, mean and population standard deviation in double."""

    def stats(px: Column) -> Column:
        return let(_mean(px), lambda mean: F.struct(
            F.array_min(px).cast("double").alias("min"),
            F.array_max(px).cast("double").alias("max"),
            mean.alias("mean"),
            F.sqrt(_mean(px, lambda x: (x - mean) * (x - mean))).alias("std"),
        ))

    return let(_c(pixels), stats)


def quantile(pixels, prob: float) -> Column:
    """Linear-interpolation quantile of one image's pixels."""

    def read(ordered: Column) -> Column:
        pos = (F.size(ordered) - 1) * F.lit(prob)
        low = F.floor(pos).cast("int")
        high = F.ceil(pos).cast("int")
        a = F.element_at(ordered, low + 1).cast("double")
        b = F.element_at(ordered, high + 1).cast("double")
        return a + (b - a) * (pos - low)

    return let(F.array_sort(_c(pixels)), read)


def mse(prediction, target) -> Column:
    """Mean squared error of two equally long arrays, without clamping."""
    p, t = _c(prediction), _c(target)
    return _mean(F.zip_with(p, t, lambda a, b: a.cast("double") - b.cast("double")), lambda d: d * d)


def psnr_from_mse(value) -> Column:
    """Unit-range PSNR; identical images give infinity (``log10(0)`` is NULL in SQL)."""
    v = _c(value)
    return F.when(v == 0, F.lit(math.inf)).otherwise(F.lit(-10.0) * F.log10(v))


def psnr(prediction, target) -> Column:
    return psnr_from_mse(mse(clamp01(prediction), clamp01(target)))


def validation_psnr_from_mse(value, floor: float = 1e-12) -> Column:
    """Training-time PSNR: the error is floored, so identical images score 120 dB."""
    return F.lit(-10.0) * F.log10(F.greatest(_c(value), F.lit(floor)))


def mean_bias(prediction, target) -> Column:
    return F.abs(_mean(clamp01(prediction)) - _mean(clamp01(target)))


def out_of_range_rate(prediction) -> Column:
    p = _c(prediction)
    return F.size(F.filter(p, lambda x: (x < 0) | (x > 1))) / F.size(p)


def charbonnier(prediction, target, eps: float = 1e-3) -> Column:
    """Mean of ``sqrt(d^2 + eps^2)``; NULL when the lengths differ."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    p, t = _c(prediction), _c(target)
    diff = F.zip_with(p, t, lambda a, b: a.cast("double") - b.cast("double"))
    return F.when(F.size(p) == F.size(t), _mean(diff, lambda d: F.sqrt(d * d + F.lit(eps * eps))))


def blended_loss(supervised, teacher, supervised_weight: float, teacher_weight: float) -> Column:
    """Weighted sum of two losses; a missing teacher term keeps the supervised one."""
    if teacher_weight <= 0 or abs(supervised_weight + teacher_weight - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1 and the teacher weight must be positive")
    s, t = _c(supervised), _c(teacher)
    return F.coalesce(F.lit(supervised_weight) * s + F.lit(teacher_weight) * t, s)


def perceptual_input(pixels) -> Column:
    """Clamp to [0,1], map to [-1,1] once, repeat to three equal channels."""
    return F.array_repeat(F.transform(clamp01(pixels), lambda x: x * 2.0 - 1.0), 3)


def metric_pair_error(ph, pw, pp, th, tw, tp) -> Column:
    """NULL when two images can be scored against each other, else the reason."""
    return (
        F.when((_c(ph) != _c(th)) | (_c(pw) != _c(tw)), F.lit("shape mismatch"))
        .when(~(all_finite(pp) & all_finite(tp)), F.lit("non-finite values"))
    )


def area_half(pixels, height: int, width: int) -> Column:
    """2x2 block means of a row-major image of fixed size."""
    half_w = width // 2

    def blocks(px: Column) -> Column:
        def block(i: Column) -> Column:
            top = F.floor(i / half_w).cast("int") * (2 * width) + (i % half_w) * 2

            def at(k: int) -> Column:
                return F.get(px, top + k).cast("double")

            return (at(0) + at(1) + at(width) + at(width + 1)) / 4.0

        return F.transform(F.sequence(F.lit(0), F.lit((height // 2) * half_w - 1)), block)

    return let(_c(pixels), blocks)


def d4(pixels, height, width, transform) -> Column:
    """One of the eight dihedral transforms as an index permutation.

    ``transform % 4`` counter-clockwise quarter turns, then a left-right flip when
    ``transform >= 4``. Returns a struct of height, width and pixels.
    """
    h, w = _c(height), _c(width)
    t = transform if isinstance(transform, Column) else F.lit(transform)
    turns = t % 4
    odd = turns % 2 == 1
    out_h, out_w = F.when(odd, w).otherwise(h), F.when(odd, h).otherwise(w)

    def turned(px: Column) -> Column:
        def source(p: Column) -> Column:
            y = F.floor(p / out_w).cast("int")
            x0 = (p % out_w).cast("int")
            x = F.when(t >= 4, out_w - 1 - x0).otherwise(x0)
            index = (
                F.when(turns == 0, y * w + x)
                .when(turns == 1, x * w + (w - 1 - y))
                .when(turns == 2, (h - 1 - y) * w + (w - 1 - x))
                .otherwise((h - 1 - x) * w + y)
            )
            return F.get(px, index.cast("int"))

        return F.transform(F.sequence(F.lit(0), h * w - 1), source)

    return F.struct(
        out_h.cast("int").alias("height"),
        out_w.cast("int").alias("width"),
        let(_c(pixels), turned).alias("pixels"),
    )


def max_abs_difference(left, right) -> Column:
    """Largest absolute element difference; 0 for empty arrays."""
    diff = F.zip_with(_c(left), _c(right), lambda a, b: F.abs(a - b))
    return F.coalesce(F.array_max(diff), F.lit(0.0))
