"""The array data source: ranges of names, pruning, pushdown and one commit per write."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables.errors import ContractError
from imgtables.functions.imaging import make_image
from imgtables.sources import register_sources
from imgtables.sources.npy_source import NpyReader, Staging, _Bounds, _escapes, cut_names, names_of
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith
from pyspark.sql import types as T

NAMES = T.StructType([T.StructField("relpath", T.StringType()), T.StructField("length", T.LongType())])


@pytest.fixture
def source(spark):
    register_sources(spark)
    return lambda root, **options: spark.read.format("imgtables_npy").options(**options).load(str(root))


def rows(spark, n, folder=""):
    return spark.range(n, numPartitions=3).select(
        F.concat(F.lit(folder), F.format_string("%05d.npy", "id")).alias("relpath"),
        make_image(F.lit(2), F.lit(3), F.array(*[(F.col("id") + k).cast("float") for k in range(6)])).alias("image"),
    )


def test_every_name_lies_in_one_range(tmp_path):
    for i in range(500):
        (tmp_path / f"{i:04d}.npy").touch()
    (tmp_path / "inner").mkdir()
    ranges, inner = cut_names(str(tmp_path), probe=100, ranges=7)
    assert inner == ["inner"] and len(ranges) == 7
    for name, is_folder, _ in names_of(str(tmp_path)):
        assert is_folder or sum(r.holds(name) for r in ranges) == 1
    assert len(cut_names(str(tmp_path), probe=1000)[0]) == 1


def test_names_are_streamed(tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"{i}.npy").touch()
    monkeypatch.setattr(os, "listdir", lambda *a: pytest.fail("a list of all names"))
    stream = names_of(str(tmp_path))
    assert next(stream)[1] is False


def test_round_trip_with_ranges(spark, source, tmp_path):
    out = str(tmp_path / "out")
    rows(spark, 300, "a/").unionByName(rows(spark, 40, "b/c/")).write.format("imgtables_npy").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["a", "b"] and not [n for n in os.listdir(tmp_path) if n.startswith(".")]
    read = source(out, probe="50", ranges="5")
    assert read.rdd.getNumPartitions() == 6
    found = {r["relpath"]: r for r in read.collect()}
    assert len(found) == 340 and found["b/c/00007.npy"]["error"] is None and found["a/00007.npy"]["length"] == 128 + 24
    assert found["a/00007.npy"]["image"]["pixels"] == [7.0, 8.0, 9.0, 10.0, 11.0, 12.0] and found["a/00001.npy"]["src_dtype"] == "float32"
    np.testing.assert_array_equal(np.load(found["a/00009.npy"]["path"]), np.arange(9, 15, dtype=np.float32).reshape(2, 3))


def test_a_schema_without_content_opens_no_file(spark, source, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "broken.npy").write_bytes(b"no array")
    (tmp_path / "x" / "._noise.npy").write_bytes(b"")
    os.chmod(tmp_path / "x" / "broken.npy", 0)
    register_sources(spark)
    names = spark.read.format("imgtables_npy").schema("relpath string, length bigint").load(str(tmp_path))
    assert [tuple(r) for r in names.collect()] == [("x/broken.npy", 8)]
    os.chmod(tmp_path / "x" / "broken.npy", 0o644)
    assert "could not load" in source(tmp_path).first()["error"]
    with pytest.raises(Exception, match="unknown columns"):
        spark.read.format("imgtables_npy").schema("other string").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="not a directory"):
        source(tmp_path / "gone").collect()


def test_filters_are_pushed_and_skip_folders(spark, source, tmp_path):
    for folder in "abc":
        rows(spark, 20, f"{folder}/").write.format("imgtables_npy").mode("overwrite").save(str(tmp_path / "out"))
    read = source(tmp_path / "out").filter("relpath >= 'b/' and relpath < 'b/00005.npy' and length > 0")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "relpath#" not in plan.split("BatchScan")[0] or ">= b/" not in plan.split("BatchScan")[0]
    assert [r["relpath"] for r in read.select("relpath").orderBy("relpath").collect()] == [f"b/{i:05d}.npy" for i in range(5)]
    reader = NpyReader(str(tmp_path / "out"), NAMES, ".npy", 100, 4)
    assert list(reader.pushFilters([StringStartsWith(("relpath",), "c/"), EqualTo(("length",), 3)])) == [EqualTo(("length",), 3)]
    assert {p.folder for p in reader.partitions()} == {"c/"}
    assert source(tmp_path / "out").filter("relpath in ('a/00001.npy', 'c/00002.npy', 'gone')").count() == 2
    assert source(tmp_path / "out").filter("relpath = 'zz'").count() == 0


def test_bounds_agree_with_python():
    paths = ["", "a", "a/", "a/b", "a/c/d", "b/x", "b0", "é/z"]
    filters = [GreaterThan(("relpath",), "a/b"), LessThanOrEqual(("relpath",), "b/x"), StringStartsWith(("relpath",), "a/"), In(("relpath",), ("a/b", "b0"))]
    tests = [lambda p: p > "a/b", lambda p: p <= "b/x", lambda p: p.startswith("a/"), lambda p: p in ("a/b", "b0")]
    for f, want in zip(filters, tests):
        bounds = _Bounds()
        assert bounds.take(f) and [bounds.allows(p) for p in paths] == [want(p) for p in paths]
        for folder in ("a/", "a/c/", "b/", "é/"):
            assert not bounds.misses(folder) or not any(want(p) for p in paths if p.startswith(folder))
    assert not _Bounds().take(EqualTo(("relpath",), 3)) and not _Bounds().take(EqualTo(("image", "height"), 3))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    register_sources(spark)
    out = tmp_path / "out"
    bad = rows(spark, 30).withColumn("relpath", F.when(F.col("relpath") == "00029.npy", "../../x").otherwise(F.col("relpath")))
    with pytest.raises(Exception, match="unsafe output path"):
        bad.write.format("imgtables_npy").mode("append").save(str(out))
    assert os.listdir(tmp_path) == []


def test_existing_output(spark, source, tmp_path):
    register_sources(spark)
    out = tmp_path / "out"
    rows(spark, 3).write.format("imgtables_npy").mode("append").save(str(out))
    with pytest.raises(Exception, match="already exists"):
        rows(spark, 2).write.format("imgtables_npy").mode("append").save(str(out))
    assert len(os.listdir(out)) == 3
    rows(spark, 1, "d/").write.format("imgtables_npy").mode("overwrite").save(str(out))
    assert sorted(os.listdir(out)) == ["00000.npy", "00001.npy", "00002.npy", "d"] and os.listdir(tmp_path) == ["out"]


def test_staging_is_a_block(tmp_path):
    with Staging(str(tmp_path / "a" / "out")) as staged:
        os.makedirs(f"{staged}/in")
        open(f"{staged}/in/x", "w").close()
        assert not (tmp_path / "a" / "out").exists()
    assert (tmp_path / "a" / "out" / "in" / "x").exists()
    with pytest.raises(RuntimeError):
        with Staging(str(tmp_path / "b")) as staged:
            os.makedirs(staged)
            raise RuntimeError
    assert os.listdir(tmp_path) == ["a"]
    with pytest.raises(ContractError):
        with Staging(str(tmp_path / "a")) as staged:
            os.makedirs(staged)
    assert [_escapes(p) for p in ("a", "a/../b", "../a", "/a", "", "a/..", "a/../../b")] == [False, False, True, True, True, True, True]
