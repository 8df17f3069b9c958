"""A small table with immutable versions, for results that several writers add to.

Each version is a Parquet folder of its own, never changed afterwards. A version becomes the
current one by creating the log entry of its number, which only one writer can do: whoever read
version ``n`` may only publish ``n + 1``, and a writer that comes second gets an error instead of
dropping the other's row. Readers see whole versions only.
"""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..errors import ContractError
from ..sources.listing import open_fs
from ..sources.images import read_bytes
from ..sources.npy_source import names_of
from .writers import upsert_experiment

LOG = "_versions"


class LostRace(ContractError):
    """Another writer published the version first; read again and repeat."""


def current_version(path: str) -> int:
    """Number of the newest version; 0 where there is none."""
    fs, at = open_fs(f"{path.rstrip('/')}/{LOG}")
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return 0
    return max((int(name[:-5]) for name, _, _ in names_of(f"{path.rstrip('/')}/{LOG}") if name.endswith(".json")), default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table at a version, the newest unless one is named; None before the first."""
    newest = current_version(path)
    wanted = newest if version is None else version
    if not 0 <= wanted <= newest or version == 0:
        raise ContractError(f"{path} has versions 1 to {newest}, not {version}")
    if wanted == 0:
        return None
    entry = json.loads(read_bytes(f"{path.rstrip('/')}/{LOG}/{wanted:010d}.json"))
    return spark.read.parquet(f"{path.rstrip('/')}/{entry['data']}")


def _create_new(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file that must not exist yet; whether this call did."""
    fs, at = open_fs(path)
    if isinstance(fs, pafs.LocalFileSystem):
        staged = f"{at}.{uuid.uuid4().hex}.tmp"
        with open(staged, "wb") as out:
            out.write(content)
        try:
            os.link(staged, at)  # fails if the name is taken, and shows the whole content at once
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = name.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = store.create(name, False)
    except Exception as error:  # the bridge wraps the store's own exception type
        if store.exists(name):
            return False
        raise error
    out.write(bytearray(content))
    out.close()
    return True


def publish_version(spark: SparkSession, path: str, table: DataFrame, expected: int) -> int:
    """Write ``table`` as the version after ``expected``; :class:`LostRace` if that exists already."""
    root, version = path.rstrip("/"), expected + 1
    data = f"version-{version:010d}-{uuid.uuid4().hex[:12]}"
    table.write.parquet(f"{root}/{data}")
    fs, at = open_fs(f"{root}/{LOG}")
    fs.create_dir(at, recursive=True)
    entry = json.dumps({"version": version, "data": data, "after": expected}, sort_keys=True).encode()
    if not _create_new(spark, f"{root}/{LOG}/{version:010d}.json", entry):
        raise LostRace(f"version {version} of {path} was published by another writer")
    return version


def record_experiment(spark: SparkSession, path: str, row: DataFrame, replace: bool = False, key: str = "experiment") -> int:
    """Add or, with ``replace``, exchange one experiment; returns the new version.

    The row is computed once; a duplicate key without ``replace`` and a lost race are errors.
    """
    version = current_version(path)
    table = read_version(spark, path) if version else None
    return publish_version(spark, path, upsert_experiment(table, row, replace, key).coalesce(1), version)
