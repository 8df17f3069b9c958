"""Readers of manifests, labels, metric summaries, profiles and training histories."""

from __future__ import annotations

import csv
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.columns import label_or_unassigned, path_error
from ..operators.checks import require_unique_nonempty
from ..schema import HISTORY_DDL, MANIFEST_FIELDS, METRICS, PROFILE_DDL, text_schema
from .images import read_bytes
from .listing import list_files, spread


def _read_text_csv(spark: SparkSession, path: str, required) -> DataFrame:
    header = spark.read.text(path).first()
    names = next(csv.reader([header[0]])) if header else []
    missing = sorted(set(required) - set(names))
    if missing:
        raise ContractError(f"{path} is missing required columns: {missing}")
    return (
        spark.read.schema(text_schema(names))
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("escape", '"')
        .csv(path)
    )


def read_manifest(spark: SparkSession, path: str, required=("stem", "split")) -> DataFrame:
    """A manifest as text columns, stem trimmed, unique and never blank."""
    rows = _read_text_csv(spark, path, required).withColumn("stem", F.trim("stem"))
    return require_unique_nonempty(rows, "stem")


def checked_pairs(manifest: DataFrame, split: str) -> DataFrame:
    """Rows of one split with ``error``: NULL, or why one of the two paths is refused."""
    rows = manifest.filter(F.trim("split") == split).select(
        F.trim("stem").alias("stem"), "input_relpath", "target_relpath", F.lit(split).alias("split")
    )
    return rows.withColumn("error", F.coalesce(path_error("input_relpath"), path_error("target_relpath")))


def select_pairs(manifest: DataFrame, split: str, files: DataFrame | None = None) -> DataFrame:
    """Rows of one split with safe paths; with a listing, both files must exist in it."""
    checked = checked_pairs(manifest, split)
    rows = checked.drop("error")
    if files is not None:
        known = files.select("relpath")
        for side in ("input", "target"):
            gone = checked.join(known, F.col(f"{side}_relpath") == F.col("relpath"), "left_anti")
            lost = gone.orderBy("stem").limit(10).collect()
            if lost:
                raise ContractError(f"{side} file does not exist for: " + ", ".join(r["stem"] for r in lost))
    bad = checked.filter("error is not null").orderBy("stem").limit(10).collect()
    if bad:
        raise ContractError("; ".join(f"{r['stem']}: {r['error']}" for r in bad))
    require_unique_nonempty(rows, "stem")
    if rows.isEmpty():
        raise ContractError(f"manifest contains no rows assigned to split '{split}'")
    return rows


def read_pairs(spark: SparkSession, manifest_path: str, root: str, split: str) -> DataFrame:
    """Existing input/target paths of one split: ``stem, input_path, target_path, split``."""
    manifest = _read_text_csv(
        spark, manifest_path, ("stem", "input_relpath", "target_relpath", "split")
    )
    files = list_files(spark, root)
    rows = select_pairs(manifest, split, files)
    for side in ("input", "target"):
        sizes = files.select(F.col("relpath").alias(f"{side}_relpath"), F.col("length").alias(f"_{side}"))
        rows = rows.join(sizes, f"{side}_relpath")
    base = F.lit(root.rstrip("/") + "/")
    return spread(
        rows.select(
            "stem",
            F.concat(base, "input_relpath").alias("input_path"),
            F.concat(base, "target_relpath").alias("target_path"),
            "split",
            (F.col("_input") + F.col("_target")).alias("length"),
        )
    ).drop("length")


def label_columns(manifest: DataFrame) -> DataFrame:
    """``stem, split, texture_cluster`` with blanks shown as ``unassigned``."""
    cluster = F.col("texture_cluster") if "texture_cluster" in manifest.columns else F.lit("")
    return manifest.select(
        F.trim("stem").alias("stem"),
        label_or_unassigned("split").alias("split"),
        label_or_unassigned(cluster).alias("texture_cluster"),
    )


def read_labels(spark: SparkSession, path: str):
    """Labels of a manifest and the SHA-256 of its file; of several parts, of their digests in name order."""
    parts = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path").collect()
    digests = [r["d"] for r in parts if not r["path"].rpartition("/")[2].startswith(("_", "."))]
    digest = digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest()
    return label_columns(read_manifest(spark, path)), digest


def manifest_identity(spark: SparkSession, path: str) -> str:
    """Content digest of a manifest's rows: what the manifest and split jobs record for their output.

    It does not depend on the number of part files, so one manifest has one identity along a
    chain of jobs.
    """
    from ..sinks.writers import dataset_digest

    rows = read_manifest(spark, path)
    return dataset_digest(rows, fields=[f for f in MANIFEST_FIELDS if f in rows.columns])


def _metric_ddl() -> str:
    one = "struct<mean:double,median:double,bootstrap_95_ci:array<double>,finite_count:bigint," \
          "non_finite_or_missing_count:bigint>"
    return "struct<`count`:bigint," + ",".join(f"{m}:{one}" for m in METRICS) + ">"


def summary_schema() -> str:
    group = _metric_ddl()
    return (
        "manifest_sha256 string, checkpoint_sha256 string, model string, aggregates "
        f"struct<all:{group},by_split:map<string,{group}>,by_texture_cluster:map<string,{group}>,"
        f"worst_psnr_decile:{group}>"
    )


def read_summary(spark: SparkSession, path) -> DataFrame:
    """Nested metric-summary JSON files, one row each, with their path."""
    rows = (
        spark.read.schema(summary_schema() + ", _corrupt string")
        .option("multiLine", "true")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )
    return require_aggregates(rows)


def require_aggregates(rows: DataFrame) -> DataFrame:
    bad = rows.filter("aggregates is null").select("path").limit(10).collect()
    if bad:
        raise ContractError("not a metric summary: " + ", ".join(r[0] for r in bad))
    return rows.drop("_corrupt")


def summary_means(rows: DataFrame) -> DataFrame:
    """Headline means of each summary as plain columns."""
    keep = [c for c in ("name", "split", "path", "manifest_sha256", "checkpoint_sha256") if c in rows.columns]
    return rows.select(
        *keep, *[F.col(f"aggregates.all.{m}.mean").alias(m) for m in ("psnr_db", "ssim", "lpips_alex")]
    )


def profile_error(profile) -> "F.Column":
    """NULL for a valid degradation profile struct, else the first violated rule."""
    p = F.col(profile) if isinstance(profile, str) else profile

    def bad_range(name, floor):
        low, high = p[name]["low"], p[name]["high"]
        finite = low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high)
        finite = finite & (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
        ok = finite & (high >= low)
        return ~F.coalesce(ok & (low >= 0) if floor else ok, F.lit(False))

    error = F.when(~F.coalesce(p["schema_version"] == 1, F.lit(False)), F.lit("unsupported schema"))
    for name in ("blur_sigma", "gaussian_noise_std", "speckle_std"):
        error = error.when(bad_range(name, True), F.lit(f"invalid range {name}"))
    modes = p["downsample_modes"]
    known = F.forall(modes, lambda m: m.isin("area", "bicubic"))
    return error.when(bad_range("additive_bias", False), F.lit("invalid range additive_bias")).when(
        ~F.coalesce((F.size(modes) > 0) & known, F.lit(False)), F.lit("invalid downsample_modes")
    )


def validate_profile(df: DataFrame, column: str = "profile") -> DataFrame:
    """Raise on the first invalid profile row; the table is returned unchanged."""
    bad = df.select(profile_error(column).alias("e")).filter("e is not null").first()
    if bad:
        raise ContractError(f"degradation profile: {bad['e']}")
    return df


def read_profile(spark: SparkSession, path: str):
    """A validated degradation profile as a nested dict, and its content hash."""
    content = read_bytes(path)
    text = content.decode("utf-8")
    row = spark.createDataFrame([(text,)], "text string").select(
        F.from_json("text", PROFILE_DDL).alias("profile")
    )
    validate_profile(row)
    return row.first()["profile"].asDict(recursive=True), hashlib.sha256(content).hexdigest()


def read_history(spark: SparkSession, path: str, run: str = "run") -> DataFrame:
    """Training history CSV; blank cells become NULL."""
    text = _read_text_csv(spark, path, ("step", "train_loss"))
    fields = [f.strip().split(" ") for f in HISTORY_DDL.split(",")]
    columns = []
    for name, kind in fields:
        if name == "run":
            columns.append(F.lit(run).alias(name))
        elif name in text.columns:
            columns.append(F.nullif(F.trim(name), F.lit("")).cast(kind).alias(name))
        else:
            columns.append(F.lit(None).cast(kind).alias(name))
    return text.select(*columns)
