"""Distributed directory listing that keeps every name, hidden or not.

Spark's own file sources silently skip names that begin with ``_`` or ``.``. Here the
directory tree is walked by tasks in rounds, one row per directory, so neither the file
names nor the directory names ever gather on the driver.
"""

from __future__ import annotations

import functools
import os

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.columns import basename, is_archive_noise, stem
from ..session import materialize

_LISTING = "is_dir boolean, path string, length bigint, modified timestamp"
_TARGET_BYTES = 64 << 20
_ENTRIES_PER_TASK = 50_000


# Schemes that Spark knows under another name than the file library does.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


@functools.lru_cache(maxsize=64)
def _store(scheme: str, authority: str):
    """One client per store and process, with the path of the store's root."""
    return pafs.FileSystem.from_uri(f"{scheme}://{authority}/")


def open_fs(uri: str):
    """Filesystem and path of a URI or a local path; clients are shared within a process."""
    if uri.startswith("dbfs:/"):
        uri = "/dbfs/" + uri[len("dbfs:/"):].lstrip("/")
    if uri.startswith("file:/"):
        uri = "/" + uri[len("file:/"):].lstrip("/")
    if "://" not in uri:
        return _store("file", "")[0], os.path.abspath(uri)
    scheme, _, rest = uri.partition("://")
    authority, _, path = rest.partition("/")
    scheme = _SCHEMES.get(scheme, scheme)
    if "?" in uri:  # options of the client are part of such a URI
        return pafs.FileSystem.from_uri(f"{scheme}://{rest}")
    fs, root = _store(scheme, authority)
    return fs, f"{root.rstrip('/')}/{path}"


def uri_prefix(uri: str) -> str:
    """What must be put before a filesystem path to open it again from a task."""
    if "://" not in uri:
        return ""
    _, path = open_fs(uri)
    return uri[: uri.rstrip("/").rfind(path.rstrip("/"))]


def _walk(prefix: str, budget: int):
    """Task body: walk subtrees until ``budget`` entries are listed, then hand back the rest.

    Directories handed back are spread over the cluster in the next round, so a small tree
    takes one job and a large one is shared out however it is shaped.
    """
    schema = pa.schema(
        [("is_dir", pa.bool_()), ("path", pa.string()), ("length", pa.int64()),
         ("modified", pa.timestamp("us", tz="UTC"))]
    )

    def batch_of(is_dir, infos):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([is_dir] * len(infos), pa.bool_()),
                pa.array([i.path for i in infos], pa.string()),
                pa.array([i.size or 0 for i in infos], pa.int64()),
                pa.array([i.mtime for i in infos], pa.timestamp("us", tz="UTC")),
            ],
            schema=schema,
        )

    def run(batches):
        seen = 0
        for batch in batches:
            stack = batch.column("path").to_pylist()
            while stack and seen < budget:
                at = stack.pop()
                fs, path = open_fs(prefix + at)
                infos = fs.get_file_info(pafs.FileSelector(path))
                seen += len(infos)
                stack.extend(i.path for i in infos if i.type == pafs.FileType.Directory)
                files = [i for i in infos if i.type == pafs.FileType.File]
                for start in range(0, len(files), 10_000):
                    yield batch_of(False, files[start : start + 10_000])
            if stack:
                yield batch_of(True, [pafs.FileInfo(path) for path in stack])

    return run


def list_files(spark: SparkSession, root: str, suffixes=(".npy",), ignore_case=False) -> DataFrame:
    """Every file under ``root`` with one of the suffixes; noise is flagged, not dropped."""
    fs, base = open_fs(root)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise ContractError(f"input directory does not exist: {root}")
    if info.type != pafs.FileType.Directory:
        raise ContractError(f"input path is not a directory: {root}")
    prefix, base = uri_prefix(root), base.rstrip("/")

    level = spark.range(0, 1, 1, 1).select(F.lit(base).alias("path"))
    found = None
    while True:
        listed = materialize(level.mapInArrow(_walk(prefix, _ENTRIES_PER_TASK), _LISTING))
        files = listed.filter(~F.col("is_dir")).drop("is_dir")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("is_dir").select("path")
        if level.isEmpty():
            break
        level = level.repartition(spark.sparkContext.defaultParallelism)

    name = basename("path")
    probe = F.lower(name) if ignore_case else name
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | probe.endswith(suffix)
    relpath = F.substr(F.col("path"), F.lit(len(base) + 2))
    return found.filter(wanted).select(
        F.concat(F.lit(prefix), "path").alias("path"),
        relpath.alias("relpath"),
        name.alias("name"),
        stem("path").alias("stem"),
        "length",
        "modified",
        is_archive_noise(relpath).alias("ignored"),
    )


def count_ignored(files: DataFrame) -> int:
    """Number of archive by-products in a :func:`list_files` listing."""
    return files.filter("ignored").count()


def spread(files: DataFrame) -> DataFrame:
    """Even out file rows so that one task reads about 64 MB; an empty listing is an error."""
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("b")).first()
    if not row["n"]:
        raise ContractError("no valid .npy inputs found")
    parallel = files.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-row["b"] // _TARGET_BYTES), min(parallel, row["n"]))
    return files.repartition(int(parts))
