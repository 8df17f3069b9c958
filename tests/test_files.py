"""Scans, sinks and the file-based jobs on small generated directories."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables import ContractError
from imgtables.functions import kernels as K
from imgtables.functions.restoring import Bicubic
from imgtables.plans import build_manifest, evaluate_files, restore, summary_document, verify_outputs
from imgtables.sinks import dataset_digest, guard_nested, guard_output, render_manifest, write_json, write_manifest, write_metrics, write_npy
from imgtables.sources import (
    count_ignored, decode_npy, list_files, read_labels, read_manifest, read_pairs, read_summary, require_even,
    scan_jpeg, scan_npy, validate_images,
)


@pytest.fixture
def dataset(tmp_path, save, rng):
    """Three aligned pairs with out-of-range values, archive noise and hidden names."""
    for i, stem in enumerate(("a", "_b", ".c")):
        low = rng.random((12 + 2 * i, 12)).astype(np.float32) * 1.5 - 0.2
        save(tmp_path / "low", f"s{i}/{stem}.npy", low)
        save(tmp_path / "high", f"{stem}.npy", K.resize_bicubic(low[None], 24 + 4 * i, 24)[0] + 0.01)
    for side in ("low", "high"):
        save(tmp_path / side, "__MACOSX/x.npy", np.zeros((2, 2)))
        save(tmp_path / side, "s/._y.npy", np.zeros((2, 2)))
    (tmp_path / "low" / "notes.txt").write_text("no")
    return tmp_path


def test_scan_sees_hidden_names_and_flags_noise(spark, dataset):
    low = str(dataset / "low")
    listed = list_files(spark, low)
    assert count_ignored(listed) == 2
    rows = {r["relpath"]: r for r in decode_npy(scan_npy(spark, low)).collect()}
    assert set(rows) == {"s0/a.npy", "s1/_b.npy", "s2/.c.npy"}
    row = rows["s2/.c.npy"]
    assert row["stem"] == ".c" and row["error"] is None and row["src_dtype"] == "float32"
    assert (row["image"]["height"], row["image"]["width"]) == (16, 12)
    assert min(row["image"]["pixels"]) < 0 and max(row["image"]["pixels"]) > 1
    content = (dataset / "low" / "s2" / ".c.npy").read_bytes()
    assert row["sha256"] == hashlib.sha256(content).hexdigest() and row["length"] == len(content)


def test_scan_errors(spark, tmp_path):
    with pytest.raises(ContractError, match="does not exist"):
        scan_npy(spark, str(tmp_path / "gone"))
    (tmp_path / "f").write_text("")
    with pytest.raises(ContractError, match="not a directory"):
        scan_npy(spark, str(tmp_path / "f"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ContractError, match="no valid"):
        scan_npy(spark, str(tmp_path / "empty"))


def test_bad_arrays_fail_or_are_quarantined(spark, tmp_path, save):
    save(tmp_path, "cube.npy", np.zeros((2, 2, 2), np.float32))
    save(tmp_path, "nan.npy", np.array([[np.nan, 1]], np.float32))
    save(tmp_path, "none.npy", np.zeros((0, 0), np.float32))
    save(tmp_path, "complex.npy", np.zeros((2, 2), np.complex64))
    save(tmp_path, "text.npy", np.array([["a"]]))
    save(tmp_path, "int.npy", np.arange(4, dtype=np.uint8).reshape(2, 2))
    (tmp_path / "junk.npy").write_bytes(b"junk")
    images = decode_npy(scan_npy(spark, str(tmp_path)))
    kept = {r["stem"]: r["error"] for r in validate_images(images, "quarantine").collect()}
    assert kept.pop("int") is None and all(kept.values()) and len(kept) == 6
    with pytest.raises(ContractError, match="nan.npy"):
        validate_images(images)
    with pytest.raises(Exception, match="npy: "):
        validate_images(images, "assert").collect()


def test_npy_round_trip_is_idempotent(spark, images, tmp_path, rng):
    df = images(image={"x": rng.random((3, 4)), "d/y": rng.random((2, 2))}).withColumn("relpath", F.concat("stem", F.lit(".npy")))
    assert write_npy(df, str(tmp_path)) == 2 and write_npy(df, str(tmp_path)) == 2
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["x.npy", "y.npy"]
    back = np.load(tmp_path / "x.npy")
    assert back.dtype == np.float32 and back.shape == (3, 4)


def test_manifest_job(spark, dataset):
    args = (spark, str(dataset / "low"), str(dataset / "high"))
    audit = build_manifest(*args, str(dataset / "m"), str(dataset / "audit.json"), expected_pairs=3)
    assert audit["pair_count"] == 3 and audit["ignored_metadata_files"] == {"input": 2, "target": 2}
    assert audit["input"]["shape_counts"] == {"12x12": 1, "14x12": 1, "16x12": 1} and audit["input"]["global_min"] < 0
    assert json.loads((dataset / "audit.json").read_text())["manifest_sha256"] == audit["manifest_sha256"]
    rows = read_manifest(spark, str(dataset / "m"))
    assert [r["stem"] for r in rows.orderBy("stem").collect()] == [".c", "_b", "a"]
    row = rows.filter("stem = 'a'").first()
    low = np.load(dataset / "low" / "s0" / "a.npy").astype(np.float64)
    assert row["input_mean"] == format(low.mean(), ".10g") and row["input_relpath"] == "low/s0/a.npy"
    assert float(row["input_std"]) == pytest.approx(low.std()) and row["target_shape"] == "24x24"

    with pytest.raises(ContractError, match="already exists"):
        build_manifest(*args, str(dataset / "m"), str(dataset / "audit.json"))
    again = build_manifest(*args, str(dataset / "m"), str(dataset / "audit.json"), overwrite=True)
    assert again["manifest_sha256"] == audit["manifest_sha256"]
    with pytest.raises(ContractError, match="expected 4 pairs"):
        build_manifest(*args, str(dataset / "m2"), str(dataset / "a2.json"), expected_pairs=4)


@pytest.mark.parametrize("bad,match", [("orphan", "missing target"), ("double", "duplicate"), ("shape", "is not 2x"), ("nan", "NaN")])
def test_manifest_refuses_bad_pairs_before_writing(spark, dataset, save, bad, match):
    if bad == "orphan":
        save(dataset / "low", "lonely.npy", np.ones((2, 2)))
    elif bad == "double":
        save(dataset / "low", "other/a.npy", np.ones((2, 2)))
    elif bad == "shape":
        save(dataset / "high", "a.npy", np.ones((4, 5)))
    else:
        save(dataset / "high", "a.npy", np.full((24, 24), np.nan))
    with pytest.raises(ContractError, match=match):
        build_manifest(spark, str(dataset / "low"), str(dataset / "high"), str(dataset / "m"), str(dataset / "a.json"))
    assert not (dataset / "m").exists() and not (dataset / "a.json").exists()


def test_exact_digest_equals_the_single_file(spark, dataset):
    build_manifest(spark, str(dataset / "low"), str(dataset / "high"), str(dataset / "m"), str(dataset / "a.json"))
    rows = render_manifest(read_manifest(spark, str(dataset / "m"), ("stem",)))
    write_manifest(rows, str(dataset / "one"), single_file=True)
    part = next((dataset / "one").glob("part-*.csv"))
    assert dataset_digest(rows, mode="csv") == hashlib.sha256(part.read_bytes()).hexdigest()
    tree = dataset_digest(rows)
    assert tree == dataset_digest(rows.repartition(5)) == dataset_digest(rows.orderBy(F.desc("stem")))
    assert tree != dataset_digest(rows.withColumn("split", F.lit("x")))


def test_restore_and_verify(spark, dataset):
    low, out = str(dataset / "low"), str(dataset / "out")
    report = restore(spark, low, out, expected=3, report_path=str(dataset / "r.json"))
    assert report["input_count"] == 3 and report["model"] == "bicubic"
    source = np.load(dataset / "low" / "s1" / "_b.npy")
    got = np.load(dataset / "out" / "s1" / "_b.npy")
    want = np.clip(K.resize_bicubic(source[None], 28, 24)[0], 0, 1)
    np.testing.assert_array_equal(got, want)
    assert verify_outputs(spark, low, out, expected=3).count() == 0
    with pytest.raises(ContractError, match="already exists"):
        restore(spark, low, out)
    with pytest.raises(ContractError, match="inside the input"):
        restore(spark, low, low + "/sub")
    np.save(dataset / "out" / "s1" / "_b.npy", got.astype(np.float64))
    os.unlink(dataset / "out" / "s0" / "a.npy")
    np.save(dataset / "out" / "extra.npy", got)
    found = {r["relpath"]: r["violation"] for r in verify_outputs(spark, low, out).collect()}
    assert found == {"s0/a.npy": "missing output", "extra.npy": "unexpected output", "s1/_b.npy": "dtype is not float32"}
    with pytest.raises(ContractError, match="expected 3"):
        verify_outputs(spark, low, out + "/s2", expected=3)


def test_restore_rejects_bad_predictions(spark, dataset):
    for bad, match in ((lambda x: x, "shape"), (lambda x: np.full((len(x), 2 * x.shape[1], 2 * x.shape[2]), np.nan), "NaN")):
        with pytest.raises(Exception, match=match):
            restore(spark, str(dataset / "low"), str(dataset / match), bad)


def test_evaluate_files_end_to_end(spark, dataset, tmp_path):
    (tmp_path / "labels.csv").write_text("stem,split,texture_cluster\n a ,val_id,t0\n_b, ,\n.c,val_ood,t1\n")
    labels, digest = read_labels(spark, str(tmp_path / "labels.csv"))
    assert digest == hashlib.sha256((tmp_path / "labels.csv").read_bytes()).hexdigest()
    low, high = str(dataset / "low"), str(dataset / "high")
    metrics, summary = evaluate_files(spark, low, high, labels=labels, samples=50)
    rows = {r["stem"]: r for r in metrics.collect()}
    assert rows["_b"]["split"] == "unassigned" and rows["a"]["texture_cluster"] == "t0"
    assert rows["a"]["prediction_shape"] == "24x24" and 20 < rows["a"]["psnr_db"] < 60
    doc = summary_document(summary, len(rows), manifest_sha256=digest, checkpoint_sha256=None)
    assert set(doc["aggregates"]) == {"all", "by_split", "by_texture_cluster", "worst_psnr_decile"}
    assert doc["aggregates"]["all"]["count"] == 3 and doc["aggregates"]["all"]["lpips_alex"]["mean"] is None
    assert doc["aggregates"]["worst_psnr_decile"]["count"] == 1
    write_json(doc, str(tmp_path / "s.json"))
    back = read_summary(spark, str(tmp_path / "s.json")).first()
    assert back["aggregates"]["all"]["psnr_db"]["mean"] == pytest.approx(doc["aggregates"]["all"]["psnr_db"]["mean"])
    one, _ = evaluate_files(spark, low, high, labels=labels, splits=["val_ood"], samples=0)
    assert [r["stem"] for r in one.collect()] == [".c"]
    with pytest.raises(ContractError, match="no rows selected"):
        evaluate_files(spark, low, high, labels=labels, splits=["nope"])
    with pytest.raises(ContractError, match="missing discovered"):
        evaluate_files(spark, low, high, labels=labels.filter("stem = 'a'"))
    write_metrics(metrics, str(tmp_path / "csv"), format="csv")
    write_metrics(metrics, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ContractError, match="not a metric summary"):
        read_summary(spark, str(tmp_path / "bad.json"))


def test_training_manifest_reader(spark, dataset, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("stem,input_relpath,target_relpath,split\na,low/s0/a.npy,high/a.npy,train\n_b,../x.npy,high/_b.npy,val\nq,low/no.npy,high/a.npy,gone\n")
    rows = read_pairs(spark, str(path), str(dataset), "train").collect()
    assert len(rows) == 1 and os.path.samefile(rows[0]["input_path"], dataset / "low" / "s0" / "a.npy")
    for split, match in (("val", "does not exist|escapes"), ("gone", "does not exist"), ("none", "no rows")):
        with pytest.raises(ContractError, match=match):
            read_pairs(spark, str(path), str(dataset), split)
    (tmp_path / "short.csv").write_text("stem\na\n")
    with pytest.raises(ContractError, match="missing required"):
        read_manifest(spark, str(tmp_path / "short.csv"))


def test_guards_and_json(tmp_path):
    guard_output(str(tmp_path / "new"))
    (tmp_path / "d").mkdir()
    guard_output(str(tmp_path / "d"))
    (tmp_path / "d" / "x").write_text("1")
    with pytest.raises(ContractError):
        guard_output(str(tmp_path / "d"))
    guard_output(str(tmp_path / "d"), overwrite=True)
    with pytest.raises(ContractError):
        guard_output(str(tmp_path / "d"), directory=False)
    guard_nested("/a/b", "/a/bc")
    with pytest.raises(ContractError):
        guard_nested("/a/b", "/a/b/../b/c")
    with pytest.raises(ContractError, match="NaN"):
        write_json({"a": {"b": [float("nan")]}}, str(tmp_path / "n.json"))
    assert not (tmp_path / "n.json").exists()


def write_jpeg(spark, path, array):
    """Encode 8-bit gray (2-D) or RGB (3-D) pixels with the JVM's own JPEG writer."""
    jvm = spark._jvm
    os.makedirs(os.path.dirname(path), exist_ok=True)
    h, w = array.shape[:2]
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if array.ndim == 2 else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            if array.ndim == 2:
                image.getRaster().setSample(x, y, 0, int(array[y, x]))
            else:
                r, g, b = (int(c) for c in array[y, x])
                image.setRGB(x, y, (r << 16) | (g << 8) | b)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(path))


def test_jpeg_scan(spark, tmp_path):
    flat = np.full((12, 14), 100, np.uint8)
    write_jpeg(spark, str(tmp_path / "c1" / "0.jpg"), flat)
    write_jpeg(spark, str(tmp_path / "c2" / "1.JPEG"), np.full((12, 12, 3), (200, 50, 50), np.uint8))
    rows = {r["relative_path"]: r for r in require_even(scan_jpeg(spark, str(tmp_path))).collect()}
    assert set(rows) == {"c1/0.jpg", "c2/1.JPEG"} and rows["c2/1.JPEG"]["defect_group"] == "c2"
    gray = np.array(rows["c1/0.jpg"]["image"]["pixels"])
    np.testing.assert_allclose(gray, 100 / 255, atol=2 / 255)
    luma = 0.299 * 200 + 0.587 * 50 + 0.114 * 50
    np.testing.assert_allclose(np.array(rows["c2/1.JPEG"]["image"]["pixels"]) * 255, luma, atol=3)
    write_jpeg(spark, str(tmp_path / "c3" / "odd.jpg"), np.zeros((13, 12), np.uint8))
    with pytest.raises(ContractError, match="odd.jpg"):
        require_even(scan_jpeg(spark, str(tmp_path)))
    write_jpeg(spark, str(tmp_path / "c4" / "_h.jpg"), flat)
    with pytest.raises(ContractError, match="hidden"):
        scan_jpeg(spark, str(tmp_path))


def test_per_worker_predictor(spark, images, rng):
    from imgtables.functions.restoring import PerWorker, predict

    df = images(x={"a": rng.random((4, 4))})
    row = df.select(predict("x", PerWorker(Bicubic), "double").alias("o")).first()["o"]
    assert (row["height"], row["width"]) == (8, 8)
