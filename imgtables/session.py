"""Session settings the image jobs rely on, and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import ContractError

# One image row is 64 KB to several MB, so Arrow batches are kept short. Bytes per
# batch are bounded by Spark itself (spark.sql.execution.arrow.maxBytesPerBatch).
ARROW_ROWS = "256"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
BROADCAST_BYTES = 256 << 10  # what Spark may size a table at and still broadcast it unasked, inside bounded_broadcasts


def configure(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches short enough for image rows; safe to call repeatedly."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="imgtables-checkpoint-"))
        else:
            raise ContractError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the checkpoint folder.

    The table survives the loss of any executor, is computed once, and later reads prune
    its columns and know its size. Nothing reads its shuffle files after the write, so Spark
    is told to remove them then.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    for noted in (_tables(spark), *_scopes()[-1:]):
        noted.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._imgtables_path = path
    return table


_local = threading.local()


def _scopes() -> list[list[str]]:
    """Paths written in each open :func:`passing_tables` of this thread."""
    return _local.__dict__.setdefault("scopes", [])


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables that :func:`materialize` writes inside are deleted at the end, but for those given to the function it yields.

    No DataFrame made from a deleted table can be read afterwards. If the block fails, its tables stay.
    """
    scopes, mine, kept = _scopes(), [], []
    scopes.append(mine)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._imgtables_path)
        return table

    ended = False
    try:
        yield keep
        ended = True
    finally:
        scopes.pop()
        stay = [p for p in mine if p in kept or not ended]
        for outer in scopes[-1:]:
            outer.extend(stay)
        _delete(spark, [p for p in mine if p not in stay])


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned and that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, [table._imgtables_path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        for noted in (_tables(spark), *_scopes()):
            if path in noted:
                noted.remove(path)
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def bounded_broadcasts(spark: SparkSession):
    """Inside, Spark broadcasts a table unasked only if it sizes it at ``BROADCAST_BYTES`` or less.

    Spark sizes a table by its compressed files and takes an explode to make one row of each, so what
    it takes for some megabytes can be gigabytes in the driver. Hints are obeyed as ever.
    """
    before = spark.conf.get(_THRESHOLD)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
        spark.conf.set(_THRESHOLD, BROADCAST_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_THRESHOLD, before)


def unless_small(table: DataFrame) -> DataFrame:
    """``table`` for a join that runs outside :func:`bounded_broadcasts`: sort-merged if Spark sizes it above ``BROADCAST_BYTES``."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table if size <= BROADCAST_BYTES else table.hint("merge")


def _tables(spark: SparkSession) -> list:
    """Paths of this session's intermediate tables."""
    context = spark.sparkContext
    if not hasattr(context, "_imgtables_tables"):
        context._imgtables_tables = []
    return context._imgtables_tables


def release_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables that :func:`materialize` wrote in this session; returns their number.

    For the end of a job: no DataFrame made from them can be read afterwards.
    """
    paths = [*_tables(spark)]
    _delete(spark, paths)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Send the library and the query modules to the Python workers, as ``--py-files`` would; once per session."""
    context = spark.sparkContext
    if getattr(context, "_imgtables_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="imgtables-"), "imgtables_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("imgtables", "queries"):
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._imgtables_shipped = True
