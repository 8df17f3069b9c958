"""Command line: ``spark-submit`` or ``python -m imgtables JOB ...`` runs one file-based job."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession, functions as F

from . import plans
from .errors import ContractError
from .functions.columns import path_error
from .functions.restoring import Bicubic, load_model, model_table
from .operators.checks import display_keys
from .session import configure, release_tables
from .sinks import guard_output, write_json, write_metrics
from .sources import load_pairs, read_labels, read_manifest, read_pairs
from .sources.images import load_npy
from .sources.tables import manifest_identity


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="imgtables", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name, *positional, **options):
        sub = jobs.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        for option, (kind, default) in options.items():
            sub.add_argument("--" + option.replace("_", "-"), type=kind, default=default)
        sub.add_argument("--overwrite", action="store_true")

    job("restore", "input_dir", "output_dir", model=(str, None), expected=(int, None), report=(str, None))
    job("manifest", "input_dir", "target_dir", "manifest", "audit", expected=(int, None), dataset_root=(str, None))
    job("hash-split", "manifest", "output", "audit", fraction=(float, 0.15), seed=(int, 2026))
    job("texture-split", "manifest", "root", "output", "audit", clusters=(int, 12),
        ood_fraction=(float, 0.15), id_fraction=(float, 0.15), seed=(int, 2026))
    job("fit-profile", "manifest", "root", "output")
    job("fit-residual", "manifest", "root", "output", patch=(int, 5))
    job("evaluate", "input_dir", "target_dir", "metrics", "summary", manifest=(str, None), split=(str, None),
        model=(str, None), samples=(int, 1000), seed=(int, 2026))
    job("verify", "input_dir", "output_dir", expected=(int, None))
    job("ablation", "baseline_id", "baseline_ood", "candidate_id", "candidate_ood", "output", experiment=(str, None), change=(str, None),
        id_psnr_tolerance=(float, 0.15), id_ssim_tolerance=(float, 0.002))
    job("select", "output")
    jobs.choices["select"].add_argument("--candidate", nargs=3, action="append", metavar=("NAME", "ID", "OOD"), required=True)
    return parser


def _model_digest(spark: SparkSession, path: str | None):
    """Identity of a stored model, or None for the built-in one."""
    return None if path is None else spark.read.parquet(path).first()["sha256"]


def _predictor(spark: SparkSession, path: str | None):
    return Bicubic() if path is None else load_model(spark.read.parquet(path))[0]


def run(spark: SparkSession, a: argparse.Namespace):
    """Run one parsed job and return what it reports."""
    if a.job == "restore":
        return plans.restore(spark, a.input_dir, a.output_dir, _predictor(spark, a.model), a.overwrite, a.expected, a.report)
    if a.job == "manifest":
        return plans.build_manifest(spark, a.input_dir, a.target_dir, a.manifest, a.audit, a.expected, a.overwrite,
                                    dataset_root=a.dataset_root)
    if a.job == "hash-split":
        return plans.assign_hash_holdout(spark, a.manifest, a.output, a.audit, a.fraction, a.seed, a.overwrite)
    if a.job == "texture-split":
        rows = read_manifest(spark, a.manifest, ("stem", "target_relpath", "texture_cluster", "split"))
        unsafe = rows.filter(path_error("target_relpath").isNotNull())
        if not unsafe.isEmpty():
            raise ContractError("paths outside the dataset root: " + display_keys(unsafe, "target_relpath"))
        path = F.concat(F.lit(a.root.rstrip("/") + "/"), "target_relpath")
        read = rows.select("stem", path.alias("path")).withColumn("_npy", load_npy("path"))
        image = F.when(F.col("_npy.error").isNull(), F.col("_npy.image")).otherwise(
            F.raise_error(F.concat_ws(": ", "path", "_npy.error"))
        )
        return plans.texture_ood_split(
            rows, read.select("stem", image.alias("image")), a.output, a.audit, a.clusters, a.ood_fraction,
            a.id_fraction, a.seed, a.overwrite,
        )[1]
    if a.job == "fit-profile":
        pairs = load_pairs(read_pairs(spark, a.manifest, a.root, "train"))
        profile = plans.fit_profile(pairs).first()["profile"].asDict(recursive=True)
        write_json(profile, a.output, a.overwrite)
        return profile
    if a.job == "fit-residual":
        model, _ = plans.fit_residual_restorer(load_pairs(read_pairs(spark, a.manifest, a.root, "train")), a.patch)
        model_table(spark, model).write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.output)
        return {"model": a.output}
    if a.job == "evaluate":
        guard_output(a.metrics, a.overwrite)
        guard_output(a.summary, a.overwrite, directory=False)
        labels, digest = None, None
        if a.manifest is not None:
            labels, digest = read_labels(spark, a.manifest)[0], manifest_identity(spark, a.manifest)
        started = time.perf_counter()
        metrics, summary = plans.evaluate_files(
            spark, a.input_dir, a.target_dir, _predictor(spark, a.model), labels,
            a.split.split(",") if a.split else None, samples=a.samples, seed=a.seed,
        )
        model = "bicubic" if a.model is None else a.model
        report = plans.evaluation_report(
            metrics, summary, model=model, elapsed_seconds=time.perf_counter() - started, samples=a.samples, seed=a.seed,
            manifest_sha256=digest, checkpoint_sha256=_model_digest(spark, a.model),
        )
        write_metrics(metrics, a.metrics, a.overwrite, format="csv")
        write_json(report, a.summary, a.overwrite)
        return report["aggregates"]["all"]
    if a.job == "ablation":
        if not a.experiment or not a.change:
            raise ContractError("--experiment and --change are needed")
        return plans.record_ablation(
            spark, a.baseline_id, a.baseline_ood, a.candidate_id, a.candidate_ood, a.output, experiment=a.experiment, isolated_change=a.change,
            id_psnr_tolerance=a.id_psnr_tolerance, id_ssim_tolerance=a.id_ssim_tolerance, replace=a.overwrite,
        ).first().asDict()
    if a.job == "select":
        names = [c[0] for c in a.candidate]
        if len(set(names)) != len(names):
            raise ContractError("duplicate candidate name: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
        table = plans.select_from_files(spark, {n: (i, o) for n, i, o in a.candidate}, a.output, a.overwrite)
        return {"winner": table.filter("winner").first()["name"]}
    bad = plans.verify_outputs(spark, a.input_dir, a.output_dir, a.expected)
    shown = [r.asDict() for r in bad.orderBy("relpath").limit(20).collect()]
    if shown:
        raise ContractError(json.dumps({"violations": bad.count(), "first": shown}))
    return {"passed": True}


def main(argv=None) -> int:
    args = _parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"imgtables {args.job}").getOrCreate())
    try:
        print(json.dumps(run(spark, args), indent=2, sort_keys=True))
    except (ContractError, OSError) as exc:
        print(f"ERROR: {exc}", file=sys.stderr)
        return 1
    finally:
        release_tables(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
