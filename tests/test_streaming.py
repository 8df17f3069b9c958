"""A growing folder is restored once per file, also after a run that failed; table functions give all variants."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables.errors import ContractError
from imgtables.functions import kernels
from imgtables.functions.variants import d4_variants, register_variants, severity_variants
from imgtables.schema import SEVERITIES
from imgtables.streaming import restore_new_files


def test_each_file_is_restored_once(spark, tmp_path, save, rng):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i in range(5):
        save(source, f"a/{i}.npy", rng.random((4, 4)).astype(np.float32))
    save(source, "__MACOSX/a/9.npy", np.zeros((4, 4), np.float32))
    first = restore_new_files(spark, source, out, mark, files_per_batch=3)
    assert first["files"] == 5 and first["batches"] == 2
    times = {n: os.stat(f"{out}/a/{n}").st_mtime_ns for n in os.listdir(f"{out}/a")}
    assert restore_new_files(spark, source, out, mark)["files"] == 0
    save(source, "b/5.npy", rng.random((6, 4)).astype(np.float32))
    assert restore_new_files(spark, source, out, mark)["files"] == 1
    assert np.load(f"{out}/b/5.npy").shape == (12, 8)
    assert times == {n: os.stat(f"{out}/a/{n}").st_mtime_ns for n in os.listdir(f"{out}/a")}


def test_a_stopped_run_goes_on_with_its_batch(spark, tmp_path, save, rng):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    save(source, "0.npy", rng.random((4, 4)).astype(np.float32))
    assert restore_new_files(spark, source, out, mark)["files"] == 1
    before = os.stat(f"{out}/0.npy").st_mtime_ns
    bad = os.path.join(source, "1.npy")
    with open(bad, "wb") as handle:
        handle.write(b"no array")
    with pytest.raises(Exception, match="could not load array"):
        restore_new_files(spark, source, out, mark)
    save(source, "1.npy", rng.random((4, 4)).astype(np.float32))
    assert restore_new_files(spark, source, out, mark)["files"] == 1
    assert sorted(os.listdir(out)) == ["0.npy", "1.npy"] and os.stat(f"{out}/0.npy").st_mtime_ns == before
    with pytest.raises(ContractError):
        restore_new_files(spark, source, out, out)


def test_table_functions(spark, images, rng):
    x = rng.random((8, 6))
    table = images(image={"p": x, "q": rng.random((4, 4))}).unionByName(
        spark.createDataFrame([("gone", None)], "stem string, image struct<height:int,width:int,pixels:array<double>>")
    )
    turned = d4_variants("double")(table.select("stem", "image").asTable()).collect()
    assert len(turned) == 16 and {r["key"] for r in turned} == {"p", "q"}
    for r in turned:
        if r["key"] == "p":
            got = np.array(r["image"]["pixels"]).reshape(r["image"]["height"], r["image"]["width"])
            np.testing.assert_array_equal(got, kernels.d4(x, r["t"]))
    register_variants(spark, dtype="double")
    table.createOrReplaceTempView("variant_images")
    rows = spark.sql("SELECT * FROM severity_variants(TABLE(SELECT stem, image FROM variant_images)) ORDER BY key, severity").collect()
    assert [(r["key"], r["severity"]) for r in rows] == [(k, s) for k in "pq" for s in sorted(SEVERITIES)]
    again = severity_variants(dtype="double")(table.select("stem", "image").repartition(3).asTable()).filter(F.col("key") == "p")
    assert {r["severity"]: r["image"] for r in again.collect()} == {r["severity"]: r["image"] for r in rows if r["key"] == "p"}
    want = kernels.degrade(x, SEVERITIES["profile_high"], kernels.row_seed(2026, "profile_high", "p"))
    got = next(r["image"] for r in rows if (r["key"], r["severity"]) == ("p", "profile_high"))
    np.testing.assert_allclose(np.array(got["pixels"]).reshape(want.shape), want)
