"""Checks on output locations; nothing is ever deleted here."""

from __future__ import annotations

import posixpath

from pyarrow import fs as pafs

from ..errors import ContractError
from ..sources.listing import open_fs


def _clean(path: str) -> str:
    return posixpath.normpath(open_fs(path)[1])


def guard_output(path: str, overwrite: bool = False, directory: bool = True) -> str:
    """Refuse an existing artifact or a non-empty directory unless ``overwrite``."""
    fs, at = open_fs(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return path
    is_dir = info.type == pafs.FileType.Directory
    if directory and not is_dir:
        raise ContractError(f"output path is not a directory: {path}")
    if not directory and is_dir:
        raise ContractError(f"artifact path is not a file: {path}")
    taken = bool(fs.get_file_info(pafs.FileSelector(at))) if is_dir else True
    if taken and not overwrite:
        raise ContractError(f"output already exists, pass overwrite=True to replace it: {path}")
    return path


def guard_different(*paths: str) -> None:
    if len({_clean(p) for p in paths}) != len(paths):
        raise ContractError("source, output and audit paths must all differ: " + ", ".join(paths))


def guard_nested(input_dir: str, output_dir: str) -> None:
    """The output may not be the input directory or lie inside it."""
    source, output = _clean(input_dir), _clean(output_dir)
    if output == source or output.startswith(source.rstrip("/") + "/"):
        raise ContractError(f"output directory must not lie inside the input directory: {output_dir}")
