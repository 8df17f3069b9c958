"""Decision tables computed from a handful of metric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..errors import ContractError
from ..functions.columns import is_finite
from ..operators.selection import competition_rank
from ..schema import LOWER_IS_BETTER, RANKED_METRICS
from ..session import materialize
from ..sinks import guard_output, record_experiment, write_json
from ..sources import read_summary


def require_one_manifest(summaries: DataFrame) -> DataFrame:
    row = summaries.agg(
        F.count_distinct("manifest_sha256").alias("n"), F.count(F.when(F.col("manifest_sha256").isNull(), 1)).alias("gone")
    ).first()
    if row["n"] != 1 or row["gone"]:
        raise ContractError("all summaries must come from the same manifest")
    return summaries


def gate_rows(summaries: DataFrame, id_psnr_tolerance: float = 0.15, id_ssim_tolerance: float = 0.002,
              keys=()) -> DataFrame:
    """Deltas, wins and decision from rows ``role, split, psnr_db, ssim, lpips_alex``.

    ``role`` is ``baseline`` or ``candidate``, ``split`` is ``val_id`` or ``val_ood``.
    """
    def cell(role, split, metric):
        return F.max(F.when((F.col("role") == role) & (F.col("split") == split), F.col(metric)))

    short = {"psnr_db": "psnr_delta_db", "ssim": "ssim_delta", "lpips_alex": "lpips_delta"}
    deltas = summaries.groupBy(*keys).agg(
        *[
            (cell("candidate", s, m) - cell("baseline", s, m)).alias(f"{tag}_{short[m]}")
            for s, tag in (("val_id", "id"), ("val_ood", "ood"))
            for m in RANKED_METRICS
        ]
    )
    wins = sum(
        (F.col(f"ood_{short[m]}") < 0 if m in LOWER_IS_BETTER else F.col(f"ood_{short[m]}") > 0).cast("int")
        for m in RANKED_METRICS
    )
    floor_p, floor_s = F.lit(-id_psnr_tolerance), F.lit(-id_ssim_tolerance)
    safe = (F.col("id_psnr_delta_db") >= floor_p) & (F.col("id_ssim_delta") >= floor_s)
    decided = deltas.withColumn("ood_metric_wins", wins).withColumn("id_psnr_floor_db", floor_p).withColumn(
        "id_ssim_floor", floor_s
    )
    reason = F.format_string(
        "%d of 3 ranked metrics better out of distribution; in distribution PSNR moved %+.6f dB and SSIM %+.6f",
        "ood_metric_wins", "id_psnr_delta_db", "id_ssim_delta",
    )
    return decided.withColumn(
        "decision", F.when(safe & (F.col("ood_metric_wins") >= 2), "keep").otherwise("reject")
    ).withColumn("reason", reason)


def ablation_gate(summaries: DataFrame, experiment: str, isolated_change: str, id_psnr_tolerance: float = 0.15,
                  id_ssim_tolerance: float = 0.002) -> DataFrame:
    """One experiment row: keep the change only if ID stays safe and OOD improves on two metrics."""
    require_one_manifest(summaries)
    if summaries.select("role", "split").distinct().count() != 4 or summaries.count() != 4:
        raise ContractError("an ablation needs baseline and candidate on val_id and val_ood")
    row = gate_rows(summaries, id_psnr_tolerance, id_ssim_tolerance)
    digests = summaries.agg(
        F.max(F.when((F.col("role") == "baseline") & (F.col("split") == "val_id"), F.col("checkpoint_sha256"))).alias("b"),
        F.max(F.when((F.col("role") == "candidate") & (F.col("split") == "val_id"), F.col("checkpoint_sha256"))).alias("c"),
        F.max("manifest_sha256").alias("m"),
    ).first()
    head = {
        "experiment": experiment, "isolated_change": isolated_change,
        "baseline_checkpoint_sha256": digests["b"], "candidate_checkpoint_sha256": digests["c"],
        "manifest_sha256": digests["m"],
    }
    return row.select(*[F.lit(v).cast("string").alias(k) for k, v in head.items()], *row.columns)


def join_candidates(summaries: DataFrame) -> DataFrame:
    """One row per candidate with ID and OOD scores; mismatched manifests or names raise."""
    checks = summaries.groupBy("name").agg(
        F.count(F.when(F.col("split") == "val_id", 1)).alias("i"),
        F.count(F.when(F.col("split") == "val_ood", 1)).alias("o"),
        F.count_distinct("manifest_sha256").alias("m"),
    )
    bad = checks.filter("i != 1 or o != 1 or m != 1").orderBy("name").limit(10).collect()
    if bad:
        raise ContractError("duplicate, incomplete or mismatched candidate(s): " + ", ".join(r["name"] for r in bad))
    require_one_manifest(summaries)
    return candidate_scores(summaries)


def candidate_scores(summaries: DataFrame) -> DataFrame:
    sides = []
    for split, tag in (("val_id", "id"), ("val_ood", "ood")):
        side = summaries.filter(F.col("split") == split)
        sides.append(side.select("name", *[F.col(m).alias(f"{tag}_{m}") for m in RANKED_METRICS]))
    return sides[0].join(sides[1], "name")


def rank_candidates(summaries: DataFrame) -> DataFrame:
    """Competition rank of every score within its split, direction-aware."""
    return summaries.select(
        "name", "split", *[competition_rank(summaries, m).alias(f"rank_{m}") for m in RANKED_METRICS]
    )


def select_model(summaries: DataFrame, check: bool = True) -> DataFrame:
    """Candidates by mean of six ranks; ties go to OOD rank, ID rank, then name."""
    if check:
        join_candidates(summaries)
    ranked = rank_candidates(summaries)
    mean = sum(F.col(f"rank_{m}") for m in RANKED_METRICS) / F.lit(3.0)

    def per(split):
        return F.max(F.when(F.col("split") == split, mean))

    table = ranked.groupBy("name").agg(
        per("val_id").alias("id_mean_rank"), per("val_ood").alias("ood_mean_rank")
    ).withColumn("mean_rank", (F.col("id_mean_rank") + F.col("ood_mean_rank")) / 2.0)
    order = Window.orderBy("mean_rank", "ood_mean_rank", "id_mean_rank", "name")  # one row per candidate
    placed = table.withColumn("selection_order", F.row_number().over(order))
    return placed.withColumn("winner", F.col("selection_order") == 1)


def selection_table(summaries: DataFrame) -> DataFrame:
    """:func:`select_model` with everything a report shows: six scores, six ranks, checkpoint.

    ``summaries`` has ``name, split, manifest_sha256, checkpoint_sha256`` and the three means;
    names must be unique and complete, and all summaries must come from one manifest. A missing
    or non-finite mean is an error.
    """
    scores = join_candidates(summaries)
    bad = scores.filter(~F.coalesce(_all_finite(scores.columns[1:]), F.lit(False))).orderBy("name").limit(10).collect()
    if bad:
        raise ContractError("no finite score of: " + ", ".join(r["name"] for r in bad))
    ranks = rank_candidates(summaries)

    def per(split, metric):
        return F.max(F.when(F.col("split") == split, F.col(f"rank_{metric}")))

    placed = ranks.groupBy("name").agg(
        *[per(split, m).alias(f"{tag}_rank_{m}") for split, tag in (("val_id", "id"), ("val_ood", "ood")) for m in RANKED_METRICS]
    )
    marks = summaries.filter("split = 'val_id'").select("name", "checkpoint_sha256", "manifest_sha256")
    return select_model(summaries, check=False).join(scores, "name").join(placed, "name").join(marks, "name")


def _all_finite(columns) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & is_finite(c)
    return known


# --- jobs from files -------------------------------------------------------------------


def read_named_summaries(spark: SparkSession, named) -> DataFrame:
    """Headline means of metric summaries, ``named`` by ``(path, columns)``: one row each with those columns."""
    rows = None
    for path, columns in named:
        one = read_summary(spark, path)
        if one.count() != 1:
            raise ContractError(f"not one metric summary: {path}")
        one = one.select(
            *[F.lit(v).alias(k) for k, v in columns.items()], F.lit(path).alias("path"), "manifest_sha256", "checkpoint_sha256",
            *[F.col(f"aggregates.all.{m}.mean").alias(m) for m in RANKED_METRICS],
        )
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ContractError("no metric summary was named")
    return materialize(rows)


def record_ablation(
    spark: SparkSession, baseline_id: str, baseline_ood: str, candidate_id: str, candidate_ood: str, output: str, *, experiment: str,
    isolated_change: str, id_psnr_tolerance: float = 0.15, id_ssim_tolerance: float = 0.002, replace: bool = False,
) -> DataFrame:
    """Gate four metric summaries and add the experiment to the versioned table ``output``; returns the row."""
    paths = {("baseline", "val_id"): baseline_id, ("baseline", "val_ood"): baseline_ood, ("candidate", "val_id"): candidate_id, ("candidate", "val_ood"): candidate_ood}
    summaries = read_named_summaries(spark, [(path, {"role": role, "split": split}) for (role, split), path in paths.items()])
    if summaries.filter(~F.coalesce(_all_finite(RANKED_METRICS), F.lit(False))).count():
        raise ContractError("a metric summary lacks a finite mean")
    row = materialize(ablation_gate(summaries, experiment, isolated_change, id_psnr_tolerance, id_ssim_tolerance).coalesce(1))
    record_experiment(spark, output, row, replace)
    return row


def select_from_files(spark: SparkSession, candidates: dict, output: str, overwrite: bool = False) -> DataFrame:
    """Rank candidates ``{name: (id summary, ood summary)}`` and write the selection report; returns the table.

    The table has one row per candidate; so has the report.
    """
    if not candidates:
        raise ContractError("no candidate was named")
    guard_output(output, overwrite, directory=False)
    named = [(path, {"name": name, "split": split}) for name, pair in candidates.items() for split, path in zip(("val_id", "val_ood"), pair)]
    table = materialize(selection_table(read_named_summaries(spark, named)).orderBy("selection_order").coalesce(1))
    rows = [r.asDict() for r in table.orderBy("selection_order").collect()]
    report = {
        "schema_version": 1,
        # The policy that readers of the report expect.
        "policy": {
            "metrics": {m: "lower" if m in LOWER_IS_BETTER else "higher" for m in RANKED_METRICS},
            "splits": ["val_id", "val_ood"],
            "aggregation": "mean of six competition ranks",
            "tie_break": "lower val_ood mean rank, then lower val_id mean rank, then name",
        },
        "manifest_sha256": rows[0]["manifest_sha256"],
        "winner": rows[0]["name"],
        "winner_checkpoint_sha256": rows[0]["checkpoint_sha256"],
        "candidates": [
            {
                "name": r["name"], "checkpoint_sha256": r["checkpoint_sha256"], "selection_order": r["selection_order"],
                **{tag: {m: r[f"{tag}_{m}"] for m in RANKED_METRICS} for tag in ("id", "ood")},
                "ranks": {f"{tag}_{m}": r[f"{tag}_rank_{m}"] for tag in ("id", "ood") for m in RANKED_METRICS},
                **{k: r[k] for k in ("id_mean_rank", "ood_mean_rank", "mean_rank")},
                "id_summary": candidates[r["name"]][0], "ood_summary": candidates[r["name"]][1],
            }
            for r in rows
        ],
    }
    write_json(report, output, overwrite)
    return table


def precision_gate(full_ms: Column, alternative_ms: Column, quality_safe: Column, min_speedup: float = 10.0):
    """``speedup_percent`` and ``use_alternative``: faster by enough and quality-safe."""
    speedup = (full_ms - alternative_ms) / full_ms * 100.0
    return speedup.alias("speedup_percent"), ((speedup >= min_speedup) & quality_safe).alias("use_alternative")


def student_gate(teacher_ms: Column, student_ms: Column, id_psnr_delta: Column, ood_psnr_delta: Column,
                 min_reduction: float = 25.0, psnr_floor: float = -0.15) -> Column:
    """Accept a smaller model only for a large latency cut at nearly unchanged quality."""
    reduction = (teacher_ms - student_ms) / teacher_ms * 100.0
    quality = (id_psnr_delta >= psnr_floor) & (ood_psnr_delta >= psnr_floor)
    return F.when((reduction >= min_reduction) & quality, "accept").otherwise("reject")
