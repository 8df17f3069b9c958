from .images import (
    decode_npy, load_npy, load_pairs, profile_npy, require_even, scan_jpeg, scan_npy, validate_images,
)
from .listing import count_ignored, list_files
from .npy_source import NpySource, register_sources
from .tables import (
    read_history, read_labels, read_manifest, read_pairs, read_profile, read_summary,
    validate_profile,
)

__all__ = [
    "NpySource", "register_sources",
    "count_ignored", "decode_npy", "list_files", "load_npy", "load_pairs", "read_history", "read_labels",
    "read_manifest", "read_pairs", "read_profile", "profile_npy", "read_summary", "require_even", "scan_jpeg",
    "scan_npy", "validate_images", "validate_profile",
]
