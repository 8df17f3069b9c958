"""Jobs that begin and end in files: versioned experiments, selection, dataset root, reports, the severity grid."""

import json

import numpy as np
import pytest

from imgtables import plans
from imgtables.__main__ import _parser, run
from imgtables.errors import ContractError
from imgtables.functions.restoring import Bicubic
from imgtables.plans.manifest import dataset_paths
from imgtables.sinks import LostRace, current_version, publish_version, read_version, record_experiment, write_json
from imgtables.sources import load_pairs, read_manifest, read_pairs
from tests.test_files import write_jpeg


def summary_file(path, psnr, ssim, lpips, manifest="m", checkpoint="c"):
    def one(v):
        return {"mean": v, "median": v, "bootstrap_95_ci": [v, v], "finite_count": 1, "non_finite_or_missing_count": 0}

    everything = {"count": 1, "psnr_db": one(psnr), "ssim": one(ssim), "lpips_alex": one(lpips)}
    write_json({"manifest_sha256": manifest, "checkpoint_sha256": checkpoint, "aggregates": {"all": everything}}, str(path))
    return str(path)


def test_versions_are_immutable_and_ordered(spark, tmp_path):
    path = str(tmp_path / "t")
    row = spark.createDataFrame([("a", "x")], "experiment string, decision string")
    assert current_version(path) == 0 and read_version(spark, path) is None
    assert record_experiment(spark, path, row) == 1
    with pytest.raises(ContractError, match="already exists"):
        record_experiment(spark, path, row)
    assert record_experiment(spark, path, row.selectExpr("experiment", "'y' as decision"), replace=True) == 2
    assert [r["decision"] for r in read_version(spark, path).collect()] == ["y"]
    assert [r["decision"] for r in read_version(spark, path, 1).collect()] == ["x"]
    with pytest.raises(ContractError, match="versions 1 to 2"):
        read_version(spark, path, 3)


def test_the_second_writer_of_a_version_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(n, "x")], "experiment string, decision string") for n in "ab")
    seen = current_version(path)
    publish_version(spark, path, one, seen)
    with pytest.raises(LostRace):
        publish_version(spark, path, two, seen)
    assert [r["experiment"] for r in read_version(spark, path).collect()] == ["a"]
    record_experiment(spark, path, two)
    assert read_version(spark, path).count() == 2


def test_ablation_from_files(spark, tmp_path):
    paths = [
        summary_file(tmp_path / "bi.json", 28.0, 0.75, 0.30, checkpoint="b"), summary_file(tmp_path / "bo.json", 26.0, 0.65, 0.40, checkpoint="b"),
        summary_file(tmp_path / "ci.json", 27.9, 0.749, 0.29), summary_file(tmp_path / "co.json", 26.2, 0.66, 0.37),
    ]
    table = str(tmp_path / "experiments")
    args = _parser().parse_args(["ablation", *paths, table, "--experiment", "e1", "--change", "depth"])
    row = run(spark, args)
    assert row["decision"] == "keep" and row["ood_metric_wins"] == 3 and row["baseline_checkpoint_sha256"] == "b"
    with pytest.raises(ContractError, match="already exists"):
        run(spark, args)
    other = summary_file(tmp_path / "x.json", 26.2, 0.66, 0.37, manifest="other")
    with pytest.raises(ContractError, match="same manifest"):
        plans.record_ablation(spark, *paths[:3], other, table, experiment="e2", isolated_change="x")
    assert read_version(spark, table).count() == 1 and current_version(table) == 1


def test_selection_from_files(spark, tmp_path):
    # Published scores of two candidates with equal mean rank; the tie goes to the better OOD rank.
    scores = {
        "baseline": ((29.228288645604167, 0.7764908591691666, 0.2708827439618125), (25.244151621725415, 0.6645521163430427, 0.35236031924684597)),
        "conditioned": ((29.226240489125, 0.7765724780562501, 0.2714418435856459), (25.251256508274583, 0.6660728102397031, 0.35307973583929503)),
    }
    named = []
    for name, sides in scores.items():
        named += ["--candidate", name, *[summary_file(tmp_path / f"{name}{k}.json", *v, checkpoint=name) for k, v in enumerate(sides)]]
    out = str(tmp_path / "selection.json")
    assert run(spark, _parser().parse_args(["select", out, *named])) == {"winner": "conditioned"}
    report = json.load(open(out))
    first, second = report["candidates"]
    assert report["winner"] == first["name"] == report["winner_checkpoint_sha256"] == "conditioned"
    assert first["ranks"] == {"id_psnr_db": 2, "id_ssim": 1, "id_lpips_alex": 2, "ood_psnr_db": 1, "ood_ssim": 1, "ood_lpips_alex": 2}
    assert first["mean_rank"] == second["mean_rank"] == 1.5 and second["selection_order"] == 2 and first["id"]["ssim"] == scores["conditioned"][0][1]
    with pytest.raises(ContractError, match="already exists"):
        run(spark, _parser().parse_args(["select", out, *named]))
    with pytest.raises(ContractError, match="duplicate candidate"):
        run(spark, _parser().parse_args(["select", out, *named, *named[:4]]))
    gone = summary_file(tmp_path / "gone.json", None, 0.5, 0.5)
    with pytest.raises(ContractError, match="no finite score"):
        plans.select_from_files(spark, {"a": (named[2], gone)}, str(tmp_path / "s.json"))


def test_dataset_root():
    assert dataset_paths("/d/a/train", "/d/b/train") == ("/d", "a/train", "b/train")
    assert dataset_paths("/d/in", "/d/in/gt") == ("/d", "in", "in/gt")
    assert dataset_paths("/d/x/../in", "/d/gt", "/d") == ("/d", "in", "gt") == dataset_paths("/d/in", "/d/gt")
    with pytest.raises(ContractError, match="outside the dataset root"):
        dataset_paths("/d/in", "/e/gt", "/d")
    with pytest.raises(ContractError, match="different stores"):
        dataset_paths("/d/in", "hdfs://h/gt")


def test_folders_of_one_name_and_no_siblings(spark, tmp_path, save, rng):
    for i in range(3):
        save(tmp_path, f"a/train/{i}.npy", rng.random((4, 4)).astype(np.float32))
        save(tmp_path, f"deep/b/train/{i}.npy", rng.random((8, 8)).astype(np.float32))
    audit = plans.build_manifest(spark, f"{tmp_path}/a/train", f"{tmp_path}/deep/b/train", f"{tmp_path}/m", f"{tmp_path}/audit.json")
    assert audit["dataset_root"] == "." and audit["input_directory"] == "a/train" and audit["target_directory"] == "deep/b/train"
    rows = read_manifest(spark, f"{tmp_path}/m").drop("split").selectExpr("*", "'train' as split")
    assert {r["input_relpath"] for r in rows.collect()} == {f"a/train/{i}.npy" for i in range(3)}
    rows.write.option("header", "true").csv(f"{tmp_path}/m2")
    assert load_pairs(read_pairs(spark, f"{tmp_path}/m2", str(tmp_path), "train")).count() == 3


def test_scoring_report(spark, tmp_path, save, rng):
    for i in range(4):
        save(tmp_path, f"in/{i}.npy", rng.random((8, 8)).astype(np.float32))
        save(tmp_path, f"gt/{i}.npy", rng.random((16, 16)).astype(np.float32))
    args = _parser().parse_args(["evaluate", f"{tmp_path}/in", f"{tmp_path}/gt", f"{tmp_path}/m", f"{tmp_path}/s.json", "--samples", "20"])
    run(spark, args)
    report = json.load(open(tmp_path / "s.json"))
    assert report["pair_count"] == 4 and report["split_counts"] == {"all_labeled": 4} and report["bootstrap"]["samples"] == 20
    assert report["metric_policy"]["lpips"] == {"enabled": False} and report["timing"]["mean_milliseconds_per_image"] > 0
    low, high = report["aggregates"]["all"]["psnr_db"]["bootstrap_95_ci"]
    assert low <= report["aggregates"]["all"]["psnr_db"]["mean"] <= high


def test_severity_grid_over_a_folder(spark, tmp_path, rng):
    for i in range(4):
        (tmp_path / "img" / f"g{i % 2}").mkdir(parents=True, exist_ok=True)
        write_jpeg(spark, str(tmp_path / "img" / f"g{i % 2}" / f"{i}.jpg"), (rng.random((24, 24)) * 255).astype(np.uint8))

    class Flat(Bicubic):
        name = "flat"

        def __call__(self, x):
            return super().__call__(x) * 0 + 0.5

    out = str(tmp_path / "out")
    report = plans.severity_grid_files(spark, str(tmp_path / "img"), out, {"bicubic": Bicubic(), "flat": Flat()}, expected=4, samples=10)
    assert report["dataset"] == {"image_count": 4, "defect_group_counts": {"g0": 2, "g1": 2}}
    assert set(report["aggregates"]) == set(report["paired_comparison"]) == {"downsample_only", "profile_low", "profile_high"}
    assert report["aggregates"]["profile_low"]["flat"]["count"] == 4
    assert 0 <= report["paired_comparison"]["profile_high"]["win_rate"]["psnr_db"] <= 1
    assert json.load(open(f"{out}/summary.json")) == json.loads(json.dumps(report))
    rows = spark.read.option("header", "true").csv(f"{out}/per_image_metrics")
    assert rows.count() == 4 * 3 * 2 and rows.columns[:4] == ["relative_path", "defect_group", "severity", "method"]
    with pytest.raises(ContractError, match="expected 5"):
        plans.severity_grid_files(spark, str(tmp_path / "img"), f"{out}2", {"bicubic": Bicubic()}, expected=5)


def test_intermediate_tables_can_be_released(spark):
    import os

    from imgtables.session import _tables, materialize, release_tables

    context = spark.sparkContext
    before, context._imgtables_tables = _tables(spark), []  # those of other tests stay
    try:
        table = materialize(spark.range(5))
        paths = [p.replace("file:", "") for p in _tables(spark)]
        assert table.count() == 5 and all(os.path.isdir(p) for p in paths)
        assert release_tables(spark) == 1 and release_tables(spark) == 0
        assert not any(os.path.exists(p) for p in paths)
    finally:
        context._imgtables_tables = before
