from .guards import guard_different, guard_nested, guard_output
from .versions import LostRace, current_version, publish_version, read_version, record_experiment
from .writers import (
    dataset_digest, render_manifest, upsert_experiment, write_json, write_manifest, write_metrics,
    write_npy,
)

__all__ = [
    "LostRace", "current_version", "publish_version", "read_version", "record_experiment",
    "dataset_digest", "guard_different", "guard_nested", "guard_output", "render_manifest",
    "upsert_experiment", "write_json", "write_manifest", "write_metrics", "write_npy",
]
