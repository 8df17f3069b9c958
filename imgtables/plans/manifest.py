"""Build a validated, hashed manifest of paired array files."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.columns import shape_text
from ..operators.checks import require_count
from ..operators.pairing import pair_listings
from ..session import materialize
from ..sinks import dataset_digest, guard_different, guard_output, render_manifest, write_json, write_manifest
from ..sources import list_files
from ..sources.images import profile_npy
from ..sources.listing import open_fs, spread, uri_prefix


def _counts_map(df: DataFrame, column: str):
    rows = df.groupBy(column).agg(F.count("*").alias("c")).filter(F.col(column).isNotNull())
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "c"))))).scalar()


def dataset_audit(manifest: DataFrame) -> DataFrame:
    """One row: pair count, and per side shape and dtype counts, global range and bytes."""
    sides = []
    for side in ("input", "target"):
        sides.append(
            F.struct(
                F.min(f"{side}_min").alias("global_min"),
                F.max(f"{side}_max").alias("global_max"),
                F.sum(f"{side}_bytes").alias("file_bytes"),
            ).alias(side)
        )
    base = manifest.agg(F.count("*").alias("pair_count"), *sides)
    for side in ("input", "target"):
        base = base.withColumn(
            side,
            F.col(side)
            .withField("shape_counts", _counts_map(manifest, f"{side}_shape"))
            .withField("dtype_counts_after_loading", _counts_map(manifest, f"{side}_dtype")),
        )
    return base


def manifest_rows(pairs: DataFrame, input_folder: str, target_folder: str, scale: int = 2) -> DataFrame:
    """Profiled and checked manifest rows with an ``error`` column, one per listed pair.

    The task that holds a pair's names reads both files; only their statistics leave it.
    """
    read = pairs.withColumn("_input", profile_npy("input_path")).withColumn("_target", profile_npy("target_path"))

    def side(name, folder):
        p = F.col(f"_{name}")
        return [
            F.concat(F.lit(folder), F.col(f"{name}_relpath")).alias(f"{name}_relpath"),
            p["height"].alias(f"{name}_h"), p["width"].alias(f"{name}_w"),
            shape_text(p["height"], p["width"]).alias(f"{name}_shape"),
            F.lit("float32").alias(f"{name}_dtype"), p["src_dtype"].alias(f"{name}_src_dtype"),
            *[p[s].alias(f"{name}_{s}") for s in ("min", "max", "mean", "std")],
            p["sha256"].alias(f"sha256_{name}"),
            F.col(f"{name}_length").alias(f"{name}_bytes"),
            p["error"].alias(f"{name}_error"),
        ]

    rows = read.select("stem", *side("input", input_folder), *side("target", target_folder))
    shape_error = F.when(
        (F.col("target_h") != scale * F.col("input_h")) | (F.col("target_w") != scale * F.col("input_w")),
        F.concat(
            F.lit("target shape "), F.col("target_shape"), F.lit(f" is not {scale}x input "), F.col("input_shape")
        ),
    )
    return rows.select(
        "*",
        F.lit("").alias("source_group"),
        F.lit("").alias("texture_cluster"),
        F.lit("").alias("split"),
        F.coalesce("input_error", "target_error", shape_error).alias("error"),
    )


def dataset_paths(input_dir: str, target_dir: str, dataset_root: str | None = None) -> tuple[str, str, str]:
    """Dataset root, and both folders relative to it ("." for the root itself).

    Without a root it is the folder that both have in common, or the one above where that is one
    of the two. A folder outside the root is an error.
    """
    given = [d for d in (input_dir, target_dir, dataset_root) if d is not None]
    stores = {d[:d.find("/", d.find("://") + 3)] if "://" in d else "" for d in given}
    if len(stores) > 1:
        raise ContractError("folders of different stores have no common dataset root: " + ", ".join(given))
    sides = [posixpath.normpath(open_fs(d)[1]) for d in (input_dir, target_dir)]
    if dataset_root is None:
        root = posixpath.commonpath(sides)
        if root in sides:
            root = posixpath.dirname(root)
    else:
        root = posixpath.normpath(open_fs(dataset_root)[1])
    inner = []
    for folder, side in zip((input_dir, target_dir), sides):
        if side != root and not side.startswith(root.rstrip("/") + "/"):
            raise ContractError(f"{folder} is outside the dataset root {root}")
        inner.append(posixpath.relpath(side, root))
    return uri_prefix(input_dir) + root, inner[0], inner[1]


def build_manifest(spark: SparkSession, input_dir: str, target_dir: str, manifest_path: str, audit_path: str,
                   expected_pairs: int | None = None, overwrite: bool = False,
                   digest_mode: str = "tree", dataset_root: str | None = None) -> dict:
    """Validate aligned 2x pairs, then write the manifest and its audit; returns the audit.

    Paths in the manifest are relative to the dataset root (see :func:`dataset_paths`), under
    which ``read_pairs`` finds them again. Only file names are shuffled. Everything is checked
    before anything is written.
    """
    root, *folders = dataset_paths(input_dir, target_dir, dataset_root)
    guard_different(input_dir, target_dir)
    guard_different(manifest_path, audit_path)
    guard_output(manifest_path, overwrite)
    guard_output(audit_path, overwrite, directory=False)

    listed = {"input": list_files(spark, input_dir), "target": list_files(spark, target_dir)}
    kept = {}
    for side, files in listed.items():
        kept[side] = files.filter(~F.col("ignored"))
    pairs = pair_listings(kept["input"], kept["target"])
    require_count(pairs, expected_pairs, "pairs")

    both = spread(pairs.withColumn("length", F.col("input_length") + F.col("target_length")))
    rows = materialize(manifest_rows(both, *["" if f == "." else f + "/" for f in folders]))
    bad = rows.filter("error is not null").orderBy("stem").select("stem", "error").limit(10).collect()
    if bad:
        raise ContractError("; ".join(f"pair '{r['stem']}': {r['error']}" for r in bad))

    audit = dataset_audit(rows).first().asDict(recursive=True)
    audit.update(
        schema_version=1,
        dataset_root=".",  # paths in the manifest begin there
        input_directory=folders[0],
        target_directory=folders[1],
        expected_pairs=expected_pairs,
        ignored_metadata_files={s: f.filter("ignored").count() for s, f in listed.items()},
        manifest_sha256=dataset_digest(render_manifest(rows), mode=digest_mode),
        input_clipped_or_normalized=False,
    )
    write_manifest(rows, manifest_path, overwrite)
    write_json(audit, audit_path, overwrite)
    return audit
