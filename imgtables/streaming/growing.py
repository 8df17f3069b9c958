"""Restore what has arrived in a folder since the last run.

A structured stream over the folder's listing with an ``availableNow`` trigger: each run takes the
files that its checkpoint does not know yet, in batches, and ends. The sink is idempotent, since a
file's name decides its place and its content is a function of the input: a batch that is repeated
after a failure writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ContractError
from ..functions.columns import is_archive_noise
from ..functions.restoring import Bicubic, restore_files
from ..sinks import guard_nested
from ..sources.listing import open_fs


_LISTING = "path string, modificationTime timestamp, length bigint, content binary"  # of Spark's binary file source


def new_files(spark: SparkSession, input_dir: str, files_per_batch: int = 10_000) -> DataFrame:
    """Stream of ``path, relpath, length`` of the array files below a folder; contents are not read.

    Spark's file stream does not see names that begin with ``_`` or ``.``.
    """
    base = open_fs(input_dir)[1].rstrip("/")
    listed = (
        spark.readStream.format("binaryFile").schema(_LISTING).option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(input_dir)
    )
    relpath = F.substr("path", F.instr("path", base + "/") + len(base) + 1)
    files = listed.select("path", relpath.alias("relpath"), "length")
    return files.filter(~is_archive_noise("relpath"))


def restore_new_files(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str, predictor=None,
                      files_per_batch: int = 10_000) -> dict:
    """Restore the files that arrived since the last run with this ``checkpoint``; returns counts.

    The checkpoint belongs to one input and one output folder. A bad file stops the run; the
    batches before it stay, and the next run begins with its batch.
    """
    guard_nested(input_dir, output_dir)
    if checkpoint.rstrip("/") in (input_dir.rstrip("/"), output_dir.rstrip("/")):
        raise ContractError("the checkpoint needs a folder of its own")
    model, done = predictor or Bicubic(), {"batches": 0, "files": 0, "bytes": 0}

    def restore(batch: DataFrame, _number: int) -> None:
        parts = max(1, batch.sparkSession.sparkContext.defaultParallelism)
        written = batch.repartition(parts).select(restore_files("path", "relpath", model, output_dir.rstrip("/")).alias("w"))
        total = written.agg(F.count("w.sha256").alias("n"), F.coalesce(F.sum("w.bytes"), F.lit(0)).alias("bytes")).first()
        done["batches"] += 1
        done["files"] += total["n"]
        done["bytes"] += total["bytes"]

    query = (
        new_files(spark, input_dir, files_per_batch).writeStream.foreachBatch(restore)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return done
