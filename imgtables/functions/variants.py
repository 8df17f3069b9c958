"""Table functions: all variants of an image from one decode.

    severity_variants()(images.select("path", "image").asTable())
    d4_variants()(images.select("path", "image").asTable())

or in SQL after ``register_variants(spark)``:

    SELECT * FROM severity_variants(TABLE(SELECT path, image FROM images))

A table argument with two columns, a key and an image, arrives in Arrow batches and leaves as
``key``, the variant's name and its image. Spark has no lateral join with Arrow table functions,
so the key takes the place of one. A null image has no variants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..schema import IMAGE_DDL, IMAGE_DOUBLE_DDL, SEVERITIES
from . import kernels
from .imaging import ImageBatch, image_array

VARIANTS = 64  # images of one output batch, about


def _table_function(label: str, kind: str, dtype: str, make):
    """``make(image, key)`` gives ``(name, image)`` pairs."""
    ddl, np_type = (IMAGE_DOUBLE_DDL, np.float64) if dtype == "double" else (IMAGE_DDL, np.float32)
    name_type = pa.string() if kind == "string" else pa.int32()

    def table(held) -> pa.Table:
        keys, names, images = zip(*held)
        return pa.Table.from_arrays([pa.array(keys, pa.string()), pa.array(names, name_type), image_array(list(images), np_type)], names=["key", label, "image"])

    class Variants:
        def eval(self, rows: pa.RecordBatch):
            keys, batch, held = rows.column(0).to_pylist(), ImageBatch(rows.column(1)), []
            for group in batch.groups():
                for i, image in zip(group, batch.stack(group)):
                    held += [(keys[i], name, made) for name, made in make(image, keys[i])]
                    if len(held) >= VARIANTS:
                        yield table(held)
                        held = []
            if held:
                yield table(held)

    return arrow_udtf(Variants, returnType=f"key string, {label} {kind}, image {ddl}")


def severity_variants(severities: dict | None = None, seed: int = 2026, dtype: str = "float"):
    """Table function to ``key, severity, image``: every degradation of the grid, seeded by key."""
    levels = severities or SEVERITIES

    def make(image, key):
        return [(name, kernels.degrade(image, level, kernels.row_seed(seed, name, key))) for name, level in levels.items()]

    return _table_function("severity", "string", dtype, make)


def d4_variants(dtype: str = "float"):
    """Table function to ``key, t, image``: the eight rotations and reflections of the square."""
    return _table_function("t", "int", dtype, lambda image, key: [(t, kernels.d4(image, t)) for t in range(8)])


def register_variants(spark: SparkSession, **options) -> None:
    """Make ``severity_variants`` and ``d4_variants`` known to SQL."""
    spark.udtf.register("severity_variants", severity_variants(**options))
    spark.udtf.register("d4_variants", d4_variants(options.get("dtype", "float")))
