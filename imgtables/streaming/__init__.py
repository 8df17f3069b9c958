"""Jobs over folders that grow."""

from .growing import restore_new_files

__all__ = ["restore_new_files"]
