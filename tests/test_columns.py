"""Column and pixel expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables import ContractError
from imgtables.functions import columns as C, imaging as I, pixels as P
from imgtables.operators import checks
from conftest import pixels


def one(spark, expr, ddl="x string", row=("x",)):
    return spark.createDataFrame([row], ddl).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("path,stem,parent,noise", [
    ("a/b.npy", "b", "a", False), ("b.tar.npy", "b.tar", "", False), (".hidden", ".hidden", "", False),
    ("__MACOSX/x.npy", "x", "__MACOSX", True), ("q/._x.npy", "._x", "q", True), ("q/_x.npy", "_x", "q", False),
])
def test_paths(spark, path, stem, parent, noise):
    row = spark.createDataFrame([(path,)], "p string").select(
        C.stem("p").alias("s"), C.parent_name("p").alias("d"), C.is_archive_noise("p").alias("n")).first()
    assert (row["s"], row["d"], row["n"]) == (stem, parent, noise)


@pytest.mark.parametrize("path,bad", [("a/b", False), ("/a", True), ("../a", True), ("a/../../b", True), ("a/../b", False), ("..a/b", False), ("", True)])
def test_path_error(spark, path, bad):
    assert (one(spark, C.path_error("x"), row=(path,)) is not None) == bad


def test_text(spark):
    assert one(spark, C.casefold_key("x"), row=("Straße",)) == "strasse"
    for value, text in ((0.25, "0.25"), (1 / 3, "0.3333333333"), (1e-7, "1e-07"), (math.inf, "inf")):
        assert one(spark, C.number_text("x"), "x double", (value,)) == text
    assert one(spark, C.number_text("x"), "x double", (None,)) is None
    assert one(spark, C.cluster_label("x"), "x int", (3,)) == "texture_03"
    import hashlib

    assert one(spark, C.rank_key("x", 7, "val_id")) == hashlib.sha256(b"7:val_id:x").hexdigest()


def test_learning_rate(spark):
    steps = spark.createDataFrame([(i,) for i in (0, 4, 5, 10, 15, 99)], "s int")
    got = [r[0] for r in steps.select(C.lr_factor("s", 15, 5)).collect()]
    want = [0.2, 1.0, 1.0, 0.5, 0.0, 0.0]
    assert got == pytest.approx(want)
    assert one(spark, C.lr_factor("x", 10, 0), "x int", (0,)) == pytest.approx(1.0)


def test_weight_choice(spark):
    rows = [(1.0, None, "raw"), (1.0, 1.0, "raw"), (1.0, 2.0, "ema"), (None, None, None)]
    df = spark.createDataFrame(rows, "r double, e double, w string")
    assert df.filter(~C.select_weights("r", "e").eqNullSafe(F.col("w"))).count() == 0


def test_expression_and_kernel_metrics_agree(images, rng):
    a = {str(i): rng.normal(0.5, 0.5, s) for i, s in enumerate([(12, 14), (16, 16), (12, 14)])}
    b = {k: rng.random(v.shape) for k, v in a.items()}
    df = images(p=a, t=b)
    row = df.select(
        P.psnr("p.pixels", "t.pixels").alias("e1"), P.mean_bias("p.pixels", "t.pixels").alias("e2"),
        P.out_of_range_rate("p.pixels").alias("e3"), I.image_metrics("p", "t").alias("m"),
    ).collect()
    for r in row:
        assert r["e1"] == pytest.approx(r["m"]["psnr_db"]) and r["e2"] == pytest.approx(r["m"]["mean_intensity_bias"])
        assert r["e3"] == pytest.approx(r["m"]["pre_clamp_out_of_range_rate"]) and r["m"]["lpips_alex"] is None


def test_d4_expression_equals_kernel(images, rng):
    df = images(x={"a": rng.random((3, 5)), "b": rng.random((4, 2))})
    rows = df.select("x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    both = rows.select(P.d4("x.pixels", "x.height", "x.width", F.col("t")).alias("e"), I.d4("x", F.col("t"), "double").alias("k"))
    for r in both.collect():
        np.testing.assert_array_equal(pixels(r["e"]), pixels(r["k"]))


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0], [1.0])], "p array<double>, t array<double>, s array<double>")
    row = df.select(P.charbonnier("p", "t").alias("c"), P.charbonnier("p", "s").alias("bad")).first()
    assert row["c"] == pytest.approx((1e-3 + math.sqrt(1 + 1e-6)) / 2) and row["bad"] is None
    with pytest.raises(ValueError):
        P.charbonnier("p", "t", eps=0.0)
    with pytest.raises(ValueError):
        P.blended_loss("p", "t", 0.5, 0.4)


def test_image_contract_and_pair_checks(spark):
    rows = [(1, 2, [1.0, 2.0], None), (1, 2, [1.0], "pixel count differs from shape"), (0, 2, [], "empty image"),
            (1, 1, [math.nan], "contains NaN or infinity"), (1, 1, None, "not a 2-D real array")]
    df = spark.createDataFrame(rows, "h int, w int, px array<double>, want string")
    assert df.filter(~P.image_error("h", "w", "px").eqNullSafe(F.col("want"))).count() == 0


def test_null_images_stay_null(spark, images):
    df = images(x={"a": np.ones((4, 4))}).withColumn("x", F.when(F.col("stem") == "z", F.col("x")))
    row = df.select(I.resize("x", 2.0).alias("r"), I.texture_descriptor("x").alias("d"), I.image_metrics("x", "x").alias("m")).first()
    assert row["r"] is None and row["d"] is None and row["m"] is None


def test_key_display_and_gates(spark):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(13)], "stem string")
    assert checks.display_keys(df, "stem").endswith("08, 09, ... (+3 more)")
    assert checks.display_keys(df.limit(1), "stem") == "00"
    with pytest.raises(ContractError, match="expected 5"):
        checks.require_count(df, 5)
    with pytest.raises(ContractError):
        checks.require_unique_nonempty(df.union(df.limit(1)), "stem")
    with pytest.raises(ContractError):
        checks.require_unique_nonempty(spark.createDataFrame([(" ",)], "stem string"), "stem")
    with pytest.raises(ContractError, match="collide"):
        checks.require_unique(spark.createDataFrame([("A/x",), ("a/X",)], "relpath string"))
    with pytest.raises(ContractError, match="restricted"):
        checks.require_train(df.withColumn("split", F.lit("train")), "val_id")
