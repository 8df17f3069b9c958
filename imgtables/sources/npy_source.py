"""``imgtables_npy``: array files as a Spark data source, read by ranges of names and written with one commit.

    register_sources(spark)
    spark.read.format("imgtables_npy").load("/data/images")                        # all columns
    spark.read.format("imgtables_npy").schema("relpath string, length bigint").load(...)  # opens no file
    images.write.format("imgtables_npy").mode("overwrite").save("/data/out")       # relpath, image

Reading: a folder whose stream of names does not end soon is cut into ranges of names, and every
range is a partition that streams the folder and keeps its own names; no list of a folder's names
exists anywhere. Only the columns of the schema asked for are made: without ``image``, ``sha256``
and the like no file is opened. Comparisons of ``relpath`` with a constant are pushed down and
skip files, and where they rule out a whole range, partitions.

Writing: tasks write below a staging folder beside the target; the driver's commit publishes
everything with one rename, or file by file where the target exists. A failed job removes its
staging folder and leaves nothing visible; a repeated task writes the same files again.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from ..errors import ContractError
from .listing import open_fs, uri_prefix

NAME = "imgtables_npy"
SCHEMA = (
    "path string, relpath string, length bigint, image struct<height:int,width:int,pixels:array<float>>, "
    "src_dtype string, sha256 string, error string"
)
OPENED = ("image", "src_dtype", "sha256", "error")
COLUMNS = ("path", "relpath", "length", "image", "src_dtype", "sha256", "error")
PROBE = 20_000  # names of a folder that planning keeps for a moment
RANGES = 16  # ranges of a longer folder; each streams the folder once
BATCH_BYTES = 16 << 20


# --- names ------------------------------------------------------------------------------------


def names_of(folder: str) -> Iterator[tuple[str, bool, int]]:
    """``(name, is folder, bytes)`` of a folder's entries, one at a time in the order of the store.

    Local and mounted folders are streamed. Other stores list a folder in one call, whose result
    is handed on entry by entry.
    """
    fs, at = open_fs(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(at) as entries:
            for entry in entries:
                inner = entry.is_dir()
                yield entry.name, inner, 0 if inner else entry.stat().st_size
        return
    for info in fs.get_file_info(pafs.FileSelector(at)):
        yield info.base_name, info.type == pafs.FileType.Directory, info.size or 0


@dataclass
class NameRange(InputPartition):
    """Names of one folder from ``low`` up to, but without, ``high``; empty ends are open."""

    folder: str  # relative to the root, "" or ending with a slash
    low: str = ""
    high: str = ""

    def holds(self, name: str) -> bool:
        return self.low <= name and (not self.high or name < self.high)


def _noise(relpath: str) -> bool:
    """Archive by-products: anything below ``__MACOSX``, and names that begin with ``._``."""
    parts = relpath.split("/")
    return "__MACOSX" in parts or parts[-1].startswith("._")


@dataclass
class _Bounds:
    """What pushed filters leave of ``relpath``."""

    low: str = ""
    high: str | None = None  # first value that is out
    only: frozenset | None = None

    def take(self, f) -> bool:
        """Narrow by one filter; whether it is now fully applied."""
        if getattr(f, "attribute", None) != ("relpath",):
            return False
        value = getattr(f, "value", None)
        if isinstance(f, In):
            if not all(isinstance(v, str) for v in value):
                return False
            return self._only(value)
        if not isinstance(value, str):
            return False
        if isinstance(f, EqualTo):
            return self._only([value])
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, value + "\0" if isinstance(f, GreaterThan) else value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self._below(value if isinstance(f, LessThan) else value + "\0")
        elif isinstance(f, StringStartsWith) and value:
            self.low = max(self.low, value)
            self._below(value[:-1] + chr(ord(value[-1]) + 1))
        else:
            return False
        return True

    def _only(self, values) -> bool:
        self.only = frozenset(values) if self.only is None else self.only & frozenset(values)
        return True

    def _below(self, value: str) -> None:
        self.high = value if self.high is None else min(self.high, value)

    def allows(self, relpath: str) -> bool:
        return self.low <= relpath and (self.high is None or relpath < self.high) and (self.only is None or relpath in self.only)

    def misses(self, folder: str) -> bool:
        """Whether no path below ``folder`` can pass."""
        if self.only is not None and not any(v.startswith(folder) for v in self.only):
            return True
        # paths below "a/" lie from "a/" up to "a0", the next character after the slash
        return bool(folder) and (self.high is not None and folder >= self.high or self.low >= folder[:-1] + "0")

    def misses_range(self, r: NameRange) -> bool:
        if self.only is not None:
            return not any(v.startswith(r.folder) and r.holds(v[len(r.folder):]) for v in self.only)
        return bool(r.high) and r.folder + r.high <= self.low or self.high is not None and r.folder + r.low >= self.high


def cut_names(folder: str, probe: int = PROBE, ranges: int = RANGES) -> tuple[list[NameRange], list[str]]:
    """Ranges of a folder's names and its inner folders.

    A folder of at most ``probe`` files is one range; a longer one is cut into ``ranges`` at even
    steps of its first ``probe`` names, which stores hand out in hash order. Names behind the
    probe only pass by, in search of inner folders.
    """
    seen, inner, more = [], [], False
    for name, is_folder, _ in names_of(folder):
        if is_folder:
            inner.append(name)
        elif len(seen) < probe:
            seen.append(name)
        else:
            more = True
    if not more:
        return ([NameRange("")] if seen else []), inner
    seen.sort()
    cuts = ["", *[seen[len(seen) * k // ranges] for k in range(1, ranges)], ""]
    return [NameRange("", low, high) for low, high in zip(cuts[:-1], cuts[1:]) if low != high or not high], inner


def _escapes(relpath: str) -> bool:
    depth = 0
    for part in relpath.split("/"):
        depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
        if depth < 0:
            return True
    return relpath.startswith("/") or depth == 0


# --- reading ----------------------------------------------------------------------------------


class NpyReader(DataSourceReader):
    def __init__(self, root: str, schema, suffix: str, probe: int, ranges: int):
        self.root, self.columns, self.suffix = root.rstrip("/"), [f.name for f in schema.fields], suffix
        self.probe, self.ranges, self.bounds = probe, ranges, _Bounds()

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self):
        fs, at = open_fs(self.root)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            raise ContractError(f"input path is not a directory: {self.root}")
        found, waiting = [], [""]
        while waiting:
            folder = waiting.pop()
            ranges, inner = cut_names(f"{self.root}/{folder}", self.probe, self.ranges)
            ranges = [NameRange(folder, r.low, r.high) for r in ranges]
            found += [r for r in ranges if not self.bounds.misses_range(r)]
            waiting += [f"{folder}{name}/" for name in inner if not self.bounds.misses(f"{folder}{name}/")]
        return found or [NameRange("", "\0", "\0")]

    def read(self, partition: NameRange):
        from .images import _decode, read_bytes

        prefix, opens = uri_prefix(self.root), [c for c in self.columns if c in OPENED]
        base = prefix + open_fs(self.root)[1].rstrip("/")
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            made = dict(zip(("path", "relpath", "length"), map(list, zip(*held))))
            columns = {n: pa.array(made[n], pa.int64() if n == "length" else pa.string()) for n in self.columns if n in made}
            if opens:
                decoded = _decode([read_bytes(p) for p in made["path"]])
                names = [f.name for f in decoded.type]
                columns.update({n: decoded.field(names.index(n)) for n in opens})
            return pa.RecordBatch.from_arrays([columns[n] for n in self.columns], names=self.columns)

        for name, is_folder, length in names_of(f"{self.root}/{partition.folder}"):
            relpath = partition.folder + name
            if is_folder or not name.endswith(self.suffix) or not partition.holds(name) or _noise(relpath) or not self.bounds.allows(relpath):
                continue
            held.append((f"{base}/{relpath}", relpath, length))
            size += length
            if size >= BATCH_BYTES or len(held) >= 1024:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


# --- writing ----------------------------------------------------------------------------------


class Staging:
    """A folder beside the target that becomes visible as a whole.

    ``publish`` renames it to the target, or moves its files one by one where the target holds
    files already and ``overwrite`` allows that; ``discard`` removes it.
    """

    def __init__(self, target: str, overwrite: bool = False):
        self.target, self.overwrite, job = target.rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        folder, _, name = self.target.rpartition("/")
        self.path = f"{folder}/.staging-{name}-{job}" if folder else f".staging-{name}-{job}"

    def publish(self) -> None:
        fs, staged = open_fs(self.path)
        _, target = open_fs(self.target)
        if fs.get_file_info(staged).type == pafs.FileType.NotFound:
            fs.create_dir(target, recursive=True)  # no row was written
            return
        there = fs.get_file_info(target).type
        if there != pafs.FileType.NotFound and next(names_of(self.target), None) is None:
            fs.delete_dir(target)  # an empty folder gives way
            there = pafs.FileType.NotFound
        if there == pafs.FileType.NotFound:
            fs.create_dir(posixpath.dirname(target), recursive=True)
            fs.move(staged, target)
            return
        if not self.overwrite:
            self.discard()
            raise ContractError(f"output already exists, pass overwrite=True to replace it: {self.target}")
        waiting = [""]
        while waiting:
            inner = waiting.pop()
            fs.create_dir(f"{target}/{inner}".rstrip("/"), recursive=True)
            for name, is_folder, _ in names_of(f"{self.path}/{inner}"):
                if is_folder:
                    waiting.append(f"{inner}{name}/")
                else:
                    fs.move(f"{staged}/{inner}{name}", f"{target}/{inner}{name}")
        fs.delete_dir(staged)

    def __enter__(self) -> str:
        """Where to write; published with the end of the block, discarded if it fails."""
        return self.path

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.publish()
        else:
            self.discard()

    def discard(self) -> None:
        fs, staged = open_fs(self.path)
        if fs.get_file_info(staged).type == pafs.FileType.Directory:
            fs.delete_dir(staged)


@dataclass
class Written(WriterCommitMessage):
    files: int = 0
    size: int = field(default=0)


class NpyWriter(DataSourceArrowWriter):
    """Rows of ``relpath, image`` as float32 ``.npy`` files."""

    def __init__(self, target: str, overwrite: bool):
        self.staging = Staging(target, overwrite)

    def write(self, iterator):
        from ..functions.imaging import ImageBatch
        from ..functions.restoring import npy_bytes, write_bytes

        done = Written()
        for batch in iterator:
            at = batch.schema.names.index
            names = batch.column(at("relpath")).to_pylist()
            images = ImageBatch(batch.column(at("image")))
            for rows in images.groups():
                for i, array in zip(rows, images.stack(rows)):
                    if _escapes(names[i]):
                        raise ContractError(f"unsafe output path: {names[i]!r}")
                    content = npy_bytes(array)
                    write_bytes(f"{self.staging.path}/{names[i]}", content)
                    done.files += 1
                    done.size += len(content)
        return done

    def commit(self, messages):
        if any(m is None for m in messages):
            self.staging.discard()
            raise ContractError("a task ended without a message")
        self.staging.publish()

    def abort(self, messages):
        self.staging.discard()


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def _root(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ContractError("a path is needed")
        return path

    def reader(self, schema):
        unknown = sorted({f.name for f in schema.fields} - set(COLUMNS))
        if unknown:
            raise ContractError(f"unknown columns: {unknown}")
        probe, ranges = int(self.options.get("probe", PROBE)), int(self.options.get("ranges", RANGES))
        return NpyReader(self._root(), schema, self.options.get("suffix", ".npy"), probe, ranges)

    def writer(self, schema, overwrite):
        if {"relpath", "image"} - {f.name for f in schema.fields}:
            raise ContractError("columns relpath and image are needed")
        return NpyWriter(self._root(), overwrite)


def register_sources(spark: SparkSession) -> None:
    """Make ``imgtables_npy`` known to the session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)
