"""Sinks for images, manifests, metric rows, JSON reports and the experiment table."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, functions as F

from ..errors import ContractError
from ..functions.columns import number_text
from ..functions.restoring import write_bytes, write_image
from ..sources.npy_source import Staging
from ..schema import EXPERIMENT_FIELDS, MANIFEST_FIELDS, MANIFEST_NUMBERS, METRIC_FIELDS, METRICS
from .guards import guard_output


def write_npy(df: DataFrame, out: str, image_col: str = "image", relpath_col: str = "relpath") -> int:
    """Store one float32 ``.npy`` per row at its relative path; returns the file count.

    Files appear when all are written, and replace files of the same names; a failed job leaves nothing.
    """
    with Staging(out, overwrite=True) as staged:
        return df.select(write_image(image_col, relpath_col, staged).alias("w")).agg(F.count("w.sha256")).first()[0]


def render_manifest(df: DataFrame) -> DataFrame:
    """Manifest columns in their fixed order as text; numbers with ten significant digits."""
    cols = [
        (number_text(f) if f in MANIFEST_NUMBERS else F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f)
        if f in df.columns else F.lit("").alias(f)
        for f in MANIFEST_FIELDS
    ]
    return df.select(*cols)


def _csv(df: DataFrame, path: str, overwrite: bool, single_file: bool = False) -> None:
    guard_output(path, overwrite)
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("header", "true").option("lineSep", "\n").option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_manifest(df: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """Sorted CSV parts (range partitioned by stem); one part only when asked for."""
    _csv(render_manifest(df).orderBy("stem"), path, overwrite, single_file)


def write_metrics(df: DataFrame, path: str, overwrite: bool = False, format: str = "parquet") -> None:
    """Per-image metric rows as Parquet, or as CSV with ten-digit numbers."""
    if format == "parquet":
        guard_output(path, overwrite)
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        return
    order = METRIC_FIELDS if "stem" in df.columns else df.columns
    fields = [f for f in order if f in df.columns]
    text = df.select(*[
        F.coalesce(number_text(f), F.lit("")).alias(f) if f in METRICS else F.col(f) for f in fields
    ])
    _csv(text, path, overwrite)


def _check_numbers(value, where="$"):
    if isinstance(value, float) and not math.isfinite(value):
        raise ContractError(f"NaN or infinity is not allowed in JSON at {where}")
    if isinstance(value, dict):
        for k, v in value.items():
            _check_numbers(v, f"{where}.{k}")
    if isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            _check_numbers(v, f"{where}[{i}]")


def write_json(report, path: str, overwrite: bool = False) -> str:
    """One sorted-key JSON report from a dict or a one-row table; returns its SHA-256."""
    if isinstance(report, DataFrame):
        rows = report.limit(2).collect()
        if len(rows) != 1:
            raise ContractError("a JSON report is exactly one row")
        report = rows[0].asDict(recursive=True)
    _check_numbers(report)
    guard_output(path, overwrite, directory=False)
    text = json.dumps(report, indent=2, sort_keys=True, allow_nan=False) + "\n"
    write_bytes(path, text.encode("utf-8"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def digest_rows(df: DataFrame, order_by: str, fields) -> DataFrame:
    """One-row table ``digest``: identity of a table's content under any partitioning.

    Row hashes are folded in key order inside buckets chosen by a hash of the key, then
    the buckets in two more levels, so no task sees more than a small share of the rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields]).cast("binary"), 256)
    leaf = df.select(
        F.col(order_by).cast("string").alias("k"), row.alias("d"),
        F.substring(F.sha2(F.col(order_by).cast("string").cast("binary"), 256), 1, 6).alias("b"),
    )

    def fold(rows: DataFrame, width: int) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("k", "d")))
        text = F.array_join(F.transform(ordered, lambda s: s["d"]), "")
        bucket = F.substring("b", 1, width)
        return rows.groupBy(bucket.alias("b")).agg(F.sha2(text.cast("binary"), 256).alias("d")).withColumn("k", F.col("b"))

    return fold(fold(fold(leaf, 6), 3), 0).select(F.col("d").alias("digest"))


def dataset_digest(df: DataFrame, order_by: str = "stem", fields=MANIFEST_FIELDS, mode: str = "tree") -> str:
    """Content identity: ``tree`` for any size, ``csv`` for the exact bytes of the sorted file.

    SHA-256 of one file has no parallel form, so ``csv`` streams the rendered lines through
    the driver one partition at a time; it is for tables that are meant to be a single file.
    """
    if mode == "tree":
        row = digest_rows(df, order_by, fields).first()
        return row["digest"] if row else hashlib.sha256(b"").hexdigest()

    def cell(name):
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike('[",\r\n]'), quoted).otherwise(c)

    hasher = hashlib.sha256((",".join(fields) + "\n").encode("utf-8"))
    lines = df.orderBy(order_by).select(F.concat_ws(",", *[cell(f) for f in fields]).alias("line"))
    for row in lines.toLocalIterator():
        hasher.update((row["line"] + "\n").encode("utf-8"))
    return hasher.hexdigest()


def upsert_experiment(table: DataFrame | None, row: DataFrame, replace: bool = False,
                      key: str = "experiment") -> DataFrame:
    """New version of the experiment table with ``row`` added or replaced by key."""
    row = row.select(*[c for c in EXPERIMENT_FIELDS if c in row.columns] or row.columns)
    if table is None:
        return row
    if not replace and not table.join(row.select(key), key, "left_semi").isEmpty():
        raise ContractError(f"{key} already exists; pass replace=True")
    return upserted(table, row, key)


def upserted(table: DataFrame, row: DataFrame, key: str = "experiment") -> DataFrame:
    return table.join(row.select(key), key, "left_anti").unionByName(row)
