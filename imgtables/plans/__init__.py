"""End-to-end jobs composed from the operators."""

from .decisions import (
    ablation_gate, precision_gate, record_ablation, select_from_files, select_model, selection_table, student_gate,
)
from .evaluate import (
    evaluate, evaluate_files, evaluation_report, severity_grid_eval, severity_grid_files, summary_document,
)
from .manifest import build_manifest, dataset_audit
from .restore import fit_residual_restorer, panel_rows, restore
from .runs import compare_runs, history_report, latency_report, verify_outputs
from .splits import assign_hash_holdout, texture_ood_split
from .training import fit_profile, materialize_training

__all__ = [
    "ablation_gate", "assign_hash_holdout", "build_manifest", "compare_runs", "dataset_audit",
    "evaluate", "evaluate_files", "evaluation_report", "severity_grid_files", "fit_profile", "fit_residual_restorer", "history_report",
    "latency_report", "materialize_training", "panel_rows", "precision_gate", "restore",
    "record_ablation", "select_from_files", "select_model", "selection_table", "severity_grid_eval", "student_gate", "summary_document", "texture_ood_split",
    "verify_outputs",
]
