"""Physical plans and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables.__main__ import main
from imgtables.functions import kernels as K
from imgtables.functions.columns import with_path_parts
from imgtables.operators.selection import hash_holdout
from imgtables.operators.summaries import bootstrap_poisson
from imgtables.plans import evaluate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, images, tmp_path, rng):
    """A Parquet table of image pairs with labels, as a user would store it."""
    high = {f"{i:02d}": rng.random((24, 24)) for i in range(6)}
    low = {k: K.resize_bicubic(v[None], 12, 12)[0] for k, v in high.items()}
    df = images(input=low, target=high).withColumn("split", F.lit("val_id")).withColumn("texture_cluster", F.lit("t"))
    df.write.parquet(str(tmp_path / "pairs"))
    return spark.read.parquet(str(tmp_path / "pairs"))


def test_scoring_is_one_narrow_pass_with_pushed_filters(stored):
    text = plan(evaluate(stored, splits=["val_id"]))
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    assert "PushedFilters: [In(split" in text or "EqualTo(split,val_id)" in text


def test_many_labels_join_the_scores_not_the_pixels(stored, monkeypatch):
    import sys

    labels = stored.select("stem", F.lit("val_ood").alias("split"), F.lit("t9").alias("texture_cluster"))
    pairs = stored.drop("split", "texture_cluster")
    few = evaluate(pairs, labels=labels, splits=["val_ood"]).orderBy("stem").collect()
    monkeypatch.setattr(sys.modules["imgtables.plans.evaluate"], "BROADCAST_ROWS", 0)
    many = evaluate(pairs, labels=labels, splits=["val_ood"])
    assert many.orderBy("stem").collect() == few and len(few) == 6
    text = plan(many)
    above = text[: text.index("ArrowEvalPython")].splitlines()  # what lies over the scoring
    assert all("input" not in line and "target#" not in line for line in above if "Exchange" in line or "Join" in line)


def test_feature_steps_change_no_statistics(stored, monkeypatch):
    import sys

    from imgtables.plans import fit_residual_restorer

    whole = fit_residual_restorer(stored.withColumn("split", F.lit("train")), patch=3)[1].orderBy("i", "j").collect()
    monkeypatch.setattr(sys.modules["imgtables.plans.restore"], "FEATURE_PIXELS", 1)
    stepped = fit_residual_restorer(stored.withColumn("split", F.lit("train")), patch=3)[1].orderBy("i", "j").collect()
    np.testing.assert_allclose([r["value"] for r in stepped], [r["value"] for r in whole])


def test_metadata_queries_do_not_read_pixels(stored):
    text = plan(hash_holdout(stored.select("stem", "texture_cluster")).select("stem", "split"))
    scan = [line for line in text.splitlines() if "FileScan" in line]
    assert scan and all("pixels" not in line for line in scan)


def test_holdout_rows_are_not_shuffled(stored):
    """The cutoff is a subquery; the labelled rows themselves pass through unmoved."""
    labelled = hash_holdout(stored.select("stem"))
    lines = [line for line in plan(labelled).splitlines() if not line.lstrip().startswith(":")]
    text = "\n".join(line.split("[")[0] for line in lines)
    assert "FileScan" in text and "Exchange" not in text and "Join" not in text and "Window" not in text


def test_bootstrap_shuffles_only_partial_sums(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("stem"), F.rand(1).alias("ssim"))
    text = plan(bootstrap_poisson(df, [], ["ssim"], 10, 1))
    first = text[text.rindex("Exchange") :]
    assert "partial_sum" in first and "Join" not in text


def test_path_parts_stay_in_the_jvm(spark):
    df = with_path_parts(spark.range(3).select(F.concat(F.lit("/r/a/"), "id").alias("p")), "p", "/r")
    assert "Python" not in plan(df)


def test_command_line_from_manifest_to_report(spark, tmp_path, save, rng, capsys):
    for i in range(8):
        high = np.clip(K.gaussian_blur(rng.random((24, 24)), 1.0), 0, 1)
        save(tmp_path / "gt", f"{i:03d}.npy", high.astype(np.float32))
        save(tmp_path / "lr", f"{i:03d}.npy", (K.resize_bicubic(high[None], 12, 12)[0] + rng.normal(0, 0.02, (12, 12))).astype(np.float32))
    at = lambda name: str(tmp_path / name)
    assert main(["manifest", at("lr"), at("gt"), at("m"), at("m.json"), "--expected", "8"]) == 0
    assert main(["hash-split", at("m"), at("split"), at("s.json"), "--fraction", "0.25"]) == 0
    assert json.loads((tmp_path / "s.json").read_text())["split_counts"] == {"train": 6, "val_id": 2}
    assert main(["texture-split", at("m"), str(tmp_path), at("ood"), at("o.json"), "--clusters", "3"]) == 0
    assert main(["fit-profile", at("split"), str(tmp_path), at("p.json")]) == 0
    assert json.loads((tmp_path / "p.json").read_text())["fit_pair_count"] == 6
    assert main(["fit-residual", at("split"), str(tmp_path), at("model"), "--patch", "3"]) == 0
    assert main(["restore", at("lr"), at("out"), "--model", at("model"), "--expected", "8"]) == 0
    assert main(["verify", at("lr"), at("out"), "--expected", "8"]) == 0
    assert main(["evaluate", at("lr"), at("gt"), at("met"), at("sum.json"), "--model", at("model"), "--samples", "20", "--manifest", at("split")]) == 0
    report = json.loads((tmp_path / "sum.json").read_text())
    assert report["manifest_sha256"] == json.loads((tmp_path / "s.json").read_text())["output_manifest_sha256"]  # one identity along the chain
    assert len(report["checkpoint_sha256"]) == 64
    assert report["pair_count"] == 8 and report["aggregates"]["all"]["psnr_db"]["mean"] > 20
    assert main(["restore", at("lr"), at("out")]) == 1
    assert "already exists" in capsys.readouterr().err
