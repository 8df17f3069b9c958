"""Score restorations and summarise them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.restoring import Bicubic, score, score_files, score_grid
from ..operators.checks import require_count, require_unique_nonempty, select_splits
from ..operators.pairing import BROADCAST_ROWS, attach_labels, pair_listings, require_known
from ..operators.summaries import paired_deltas, paired_summary, summarize, summarize_scopes
from ..schema import GRID_FIELDS, METRIC_FIELDS, METRICS, SEVERITIES
from ..session import materialize
from ..sinks import guard_output, write_json, write_metrics
from ..sources import list_files, require_even, scan_jpeg
from ..sources.listing import spread


def evaluate(pairs: DataFrame, predictor=None, labels: DataFrame | None = None, splits=None,
             perceptual=None, input_col: str = "input", target_col: str = "target") -> DataFrame:
    """Per-image metric rows of paired image columns.

    Pixels are never shuffled. Up to a million labels are broadcast, and images of other splits
    are not scored; more labels join the narrow score rows, and the split filter follows.
    """
    made = score(input_col, target_col, predictor or Bicubic(), perceptual).alias("m")
    if labels is not None and labels.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        scored = pairs.select("stem", made).select("stem", "m.*")
        return select_splits(attach_labels(scored, labels), splits).select(*METRIC_FIELDS)
    labels = None if labels is None else F.broadcast(labels)
    labelled = attach_labels(pairs, labels) if labels is not None or "split" not in pairs.columns else pairs
    chosen = select_splits(labelled, splits).select("stem", "split", "texture_cluster", made)
    return chosen.select("stem", "split", "texture_cluster", "m.*").select(*METRIC_FIELDS)


def evaluate_files(spark: SparkSession, input_dir: str, target_dir: str, predictor=None,
                   labels: DataFrame | None = None, splits=None, perceptual=None,
                   samples: int = 1000, seed: int = 2026):
    """``(metrics, summary)`` of two directories of array files paired by stem.

    Only names and labels are joined; each task reads the two files of its own pairs.
    """
    if splits and labels is None:
        raise ContractError("a split filter needs a manifest")
    sides = []
    for root in (input_dir, target_dir):
        sides.append(list_files(spark, root).filter(~F.col("ignored")))
    joined = materialize(pair_listings(*sides))  # names only; checks and scoring read it again
    if labels is not None:
        require_known(joined, labels)
    chosen = select_splits(attach_labels(joined, labels), splits)
    spread_out = spread(chosen.withColumn("length", F.col("input_length") + F.col("target_length")))
    scored = spread_out.select(
        "stem", "split", "texture_cluster",
        score_files("input_path", "target_path", predictor or Bicubic(), perceptual).alias("m"),
    )
    metrics = materialize(scored.select("stem", "split", "texture_cluster", "m.*").select(*METRIC_FIELDS))
    return metrics, summarize_scopes(metrics, samples=samples, seed=seed)


def summary_document(summary: DataFrame, pair_count: int, **extra) -> dict:
    """Nested report of a long summary, for callers whose groups fit one document.

    The long summary is the result of an evaluation; this form is built from its rows on the
    driver, one row per scope, group and metric.
    """
    nested: dict = {"all": {}, "worst_psnr_decile": {}}
    for r in summary.toLocalIterator():
        place = nested.setdefault(r["scope"], {})
        if r["scope"].startswith("by_"):
            place = place.setdefault(r["group_key"], {})
        place["count"] = r["count"]
        place[r["metric"]] = {
            "mean": r["mean"],
            "median": r["median"],
            "bootstrap_95_ci": [r["ci_lo"], r["ci_hi"]],
            "finite_count": r["finite_count"],
            "non_finite_or_missing_count": r["missing_count"],
        }
    return {"schema_version": 1, "pair_count": pair_count, "aggregates": nested, **extra}


# How the scores of a report are defined, as its readers expect them.
SSIM_POLICY = {
    "window_size": 11, "sigma": 1.5, "padding": "valid", "data_range": 1.0, "k1": 0.01, "k2": 0.03, "covariance": "population",
}


def metric_policy(perceptual: bool) -> dict:
    """The definitions behind a report's scores."""
    return {
        "psnr_data_range": 1.0, "ssim": SSIM_POLICY, "lpips": {"enabled": perceptual},
        "non_finite": "counted apart; left out of mean, median and interval",
    }


def evaluation_report(metrics: DataFrame, summary: DataFrame, *, model: str, elapsed_seconds: float, samples: int, seed: int,
                      perceptual: bool = False, **extra) -> dict:
    """The scoring job's document: counts by split, timing, policy and bootstrap setting around the aggregates."""
    counts = {r["split"]: r["n"] for r in metrics.groupBy("split").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    return summary_document(
        summary, total, model=model, split_counts={k if k is not None else "": counts[k] for k in sorted(counts, key=lambda k: k or "")},
        timing={"elapsed_seconds": elapsed_seconds, "mean_milliseconds_per_image": elapsed_seconds * 1000.0 / total if total else None},
        metric_policy=metric_policy(perceptual), bootstrap={"samples": samples, "seed": seed, "confidence": 0.95, "method": "poisson"}, **extra,
    )


def severity_grid_files(spark: SparkSession, image_root: str, output_dir: str, predictors: dict, *, severities: dict | None = None,
                        expected: int | None = None, samples: int = 0, seed: int = 2026, perceptual=None, overwrite: bool = False) -> dict:
    """The severity grid over a folder of JPEG files: per-image metrics as text and a summary document.

    Every image must decode and have even sides; the number of images is checked first, and
    nothing is written before all scores exist. The first predictor is the baseline.
    """
    guard_output(output_dir, overwrite)
    images = materialize(require_even(scan_jpeg(spark, image_root)))  # decoded once for checks, counts and scores
    rows, summary, paired = severity_grid_eval(images, predictors, severities, seed, samples, expected, perceptual)
    groups = {r["defect_group"]: r["n"] for r in images.groupBy("defect_group").agg(F.count("*").alias("n")).collect()}

    def stats(r) -> dict:
        return {
            "mean": r["mean"], "median": r["median"], "bootstrap_95_ci": [r["ci_lo"], r["ci_hi"]],
            "finite_count": r["finite_count"], "non_finite_or_missing_count": r["missing_count"],
        }

    aggregates: dict = {}
    for r in summary.collect():
        place = aggregates.setdefault(r["severity"], {}).setdefault(r["method"], {})
        place["count"] = r["count"]
        place[r["metric"]] = stats(r)
    compared: dict = {}
    for r in paired.collect() if paired is not None else ():
        place = compared.setdefault(r["severity"], {"candidate_minus_baseline": {}, "win_rate": {}})
        place["candidate_minus_baseline"][r["metric"]] = stats(r)
        place["win_rate"][r["metric"]] = r["win_rate"]
    report = {
        "schema_version": 1, "dataset": {"image_count": sum(groups.values()), "defect_group_counts": dict(sorted(groups.items()))},
        "protocol": {
            "seed": seed, "scale": 2, "severities": severities or SEVERITIES, "metric_policy": metric_policy(perceptual is not None),
            "bootstrap_samples": samples, "methods": list(predictors),
        },
        "aggregates": aggregates, "paired_comparison": compared,
    }
    write_metrics(rows.select(*GRID_FIELDS), f"{output_dir.rstrip('/')}/per_image_metrics", overwrite, format="csv")
    write_json(report, f"{output_dir.rstrip('/')}/summary.json", overwrite)
    return report


def severity_grid_eval(references: DataFrame, predictors: dict, severities: dict | None = None,
                       seed: int = 2026, samples: int = 0, expected: int | None = None, perceptual=None):
    """``(rows, summary, paired)`` over reference images, severities and methods.

    ``references`` holds ``relative_path``, ``defect_group`` and ``image``; the first
    predictor is the baseline of the paired comparison. Keys and counts are checked before
    any image is scored; each image is decoded once.
    """
    severities = severities or SEVERITIES
    require_count(require_unique_nonempty(references.select("relative_path"), "relative_path"), expected, "images")
    grid = score_grid("image", "relative_path", severities, predictors, seed, perceptual)
    rows = materialize(
        references.select("relative_path", "defect_group", grid.alias("g")).select(
            "relative_path", "defect_group", F.inline("g")
        )
    )
    names = list(severities), list(predictors)
    base = F.lit(seed)
    for i, s in enumerate(names[0]):
        for j, m in enumerate(names[1]):
            here = (F.col("severity") == s) & (F.col("method") == m)
            base = F.when(here, F.lit(seed + 1000 * i + 100 * j)).otherwise(base)
    summary = summarize(
        rows.withColumn("_seed", base), ["severity", "method"], METRICS[:5], samples, seed, key="relative_path"
    )
    if len(predictors) < 2:
        return rows, summary, None
    deltas = paired_deltas(rows, *names[1][:2])
    base = F.lit(seed)
    for i, s in enumerate(names[0]):
        base = F.when(F.col("severity") == s, F.lit(seed + 10_000 + 100 * i)).otherwise(base)
    paired = paired_summary(deltas.withColumn("_seed", base), samples=samples, seed=seed)
    return rows, summary, paired
