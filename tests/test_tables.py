"""Selections, summaries, clustering, splits, training rows and decisions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables import ContractError
from imgtables.functions import kernels as K
from imgtables.functions.restoring import Bicubic, create_predictor, load_model, model_table, score_grid
from imgtables.operators import clustering, quantiles, selection, summaries, tensors
from imgtables.operators.quantiles import exact_quantiles
from imgtables.plans import (
    ablation_gate, assign_hash_holdout, compare_runs, evaluate, fit_profile, fit_residual_restorer,
    materialize_training, panel_rows, select_model, severity_grid_eval, texture_ood_split,
)
from imgtables.plans.restore import validate_predictor
from imgtables.schema import SEVERITIES
from imgtables.sinks import upsert_experiment
from conftest import pixels


# --- order statistics ---------------------------------------------------------


@pytest.mark.parametrize("kind", ["linear", "nearest"])
@pytest.mark.parametrize("buffer_rows", [10**6, 0])
def test_exact_quantiles_on_ties_and_skew(spark, rng, kind, buffer_rows, monkeypatch):
    """One group holds most rows and one value a third of them."""
    monkeypatch.setattr(quantiles, "WHOLE_ROWS", 5_000)  # the hot group is really bracketed
    hot = np.where(rng.random(40_000) < 0.33, 0.5, rng.normal(size=40_000))
    groups = {"hot": hot, "one": np.array([3.0]), "pair": np.array([1.0, 2.0]), "flat": np.ones(50)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs, kind, buffer_rows).collect()}
    for k, values in groups.items():
        ordered = np.sort(values)
        want = np.quantile(values, probs) if kind == "linear" else [ordered[round((len(values) - 1) * p)] for p in probs]
        np.testing.assert_allclose(got[k], want, rtol=1e-12)


def test_global_rank_with_one_hot_value(spark):
    df = spark.createDataFrame([(1.0 if i % 3 else float(i), f"{i:05d}") for i in range(5000)], "v double, stem string")
    got = [r["stem"] for r in selection.global_rank(df.repartition(6), "v", "stem").orderBy("_rank").collect()]
    assert got == [r["stem"] for r in df.orderBy("v", "stem").collect()]


def test_worst_fraction_counts_all_rows_and_cuts_ties(spark, monkeypatch):
    rows = [(f"{i:03d}", 1.0) for i in range(40)] + [("x", math.inf), ("y", None)] + [(f"z{i}", 9.0) for i in range(8)]
    df = spark.createDataFrame(rows, "stem string, psnr_db double")
    for limit in (10**6, 0):  # the second value forces the distributed tie cut
        monkeypatch.setattr(selection, "TIE_ROWS", limit)
        got = sorted(r["stem"] for r in selection.worst_fraction(df).collect())
        assert got == [f"{i:03d}" for i in range(5)]
    assert selection.worst_fraction(df.filter("stem = 'x'")).count() == 0


# --- splits --------------------------------------------------------------------


def test_hash_holdout_is_exact_and_order_free(spark):
    df = spark.createDataFrame([(f"{i:06d}", "") for i in range(20)], "stem string, split string")
    a = selection.hash_holdout(df)
    assert a.filter("split = 'val_id'").count() == 3
    b = selection.hash_holdout(df.orderBy(F.desc("stem")).repartition(5))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    import hashlib

    ranked = sorted((f"{i:06d}" for i in range(20)), key=lambda s: hashlib.sha256(f"2026:{s}".encode()).digest())
    assert {r["stem"] for r in a.filter("split = 'val_id'").collect()} == set(ranked[:3])
    for fraction in (0.0, 1.0):
        with pytest.raises(ContractError):
            selection.hash_holdout(df, fraction)


def test_hash_holdout_job(spark, tmp_path):
    (tmp_path / "m.csv").write_text("stem,split\n" + "".join(f"{i:06d},\n" for i in range(20)))
    audit = assign_hash_holdout(spark, str(tmp_path / "m.csv"), str(tmp_path / "o"), str(tmp_path / "a.json"))
    assert audit["split_counts"] == {"train": 17, "val_id": 3}
    with pytest.raises(ContractError, match="differ"):
        assign_hash_holdout(spark, str(tmp_path / "m.csv"), str(tmp_path / "m.csv"), str(tmp_path / "a.json"), overwrite=True)


def loop_quotas(sizes, target):
    """Plain largest-remainder loop, for comparison."""
    rate = target / sum(sizes.values())
    base = {c: max(0, min(s - 1, int(s * rate))) for c, s in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(sizes[c] * rate - base[c]), c))
    while sum(base.values()) < target:
        for c in order:
            if base[c] < sizes[c] - 1 and sum(base.values()) < target:
                base[c] += 1
    return base


def loop_pick(rows, target):
    taken, total = set(), 0
    for c, size, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if taken and (total >= target or abs(total - target) <= abs(total + size - target)):
            break
        taken.add(c)
        total += size
    return taken


def test_allocation_matches_plain_loops(spark, rng):
    for case in range(12):
        k = int(rng.integers(2, 9))
        rows = [(c, int(rng.integers(1, 40)), float(rng.integers(0, 5))) for c in range(k)]
        df = spark.createDataFrame(rows, "cluster int, size bigint, distance double")
        total = sum(r[1] for r in rows)
        picked = {r["cluster"] for r in selection.pick_ood_clusters(df, round(total * 0.3)).filter("ood").collect()}
        assert picked == loop_pick(rows, round(total * 0.3))
        room = sum(r[1] - 1 for r in rows)
        target = int(rng.integers(0, room + 1))
        got = {r["cluster"]: r["quota"] for r in selection.largest_remainder(df, target).collect()}
        assert got == loop_quotas({c: s for c, s, _ in rows}, target)
    with pytest.raises(ContractError):
        selection.largest_remainder(df, room + 1)


@pytest.fixture
def textures(images):
    rng = np.random.default_rng(5)
    made = {}
    for i in range(15):
        made[f"flat{i:02d}"] = np.full((24, 24), 0.4) + rng.normal(0, 0.002, (24, 24))
        made[f"ramp{i:02d}"] = np.tile(np.linspace(0, 1, 24), (24, 1)) + rng.normal(0, 0.01, (24, 24))
        made[f"check{i:02d}"] = np.indices((24, 24)).sum(axis=0) % 2 * 0.8 + rng.normal(0, 0.01, (24, 24))
        made[f"noise{i:02d}"] = rng.random((24, 24))
    return images(image=made)


def test_texture_ood_split(spark, textures, tmp_path):
    manifest = textures.select("stem", F.concat("stem", F.lit(".npy")).alias("target_relpath"), F.lit("").alias("texture_cluster"), F.lit("").alias("split"))
    labelled, audit = texture_ood_split(manifest, textures, str(tmp_path / "m"), str(tmp_path / "a.json"), cluster_count=4)
    rows = labelled.collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["texture_cluster"], []).append(r)
    ood = set(audit["ood_clusters"])
    for cluster, members in kinds.items():
        assert ({m["split"] for m in members} == {"val_ood"}) == (cluster in ood)
        assert len({m["stem"].rstrip("0123456789") for m in members}) == 1 and len(members) == 15
    assert audit["split_counts"] == {"train": 36, "val_id": 9, "val_ood": 15}

    shuffled = textures.orderBy(F.desc("stem")).repartition(6)
    again, second = texture_ood_split(manifest.repartition(3), shuffled, cluster_count=4)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    assert second["output_manifest_sha256"] == audit["output_manifest_sha256"] and second["kmeans_inertia"] == audit["kmeans_inertia"]
    for bad in ({"cluster_count": 2}, {"ood_fraction": 0.6, "id_fraction": 0.4}, {"cluster_count": 60}):
        with pytest.raises(ContractError):
            texture_ood_split(manifest, textures, **bad)


def test_kmeans_reaches_a_fixed_point_and_fills_clusters(spark, rng):
    points = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(f"{i:03d}", *map(float, p)) for i, p in enumerate(points)], "stem string, x double, y double")
    fit = clustering.kmeans(df.repartition(4), ["x", "y"], 3)
    labels = {r["stem"]: r["cluster"] for r in fit.assignments.collect()}
    groups = [{labels[f"{i:03d}"] for i in range(a, a + 30)} for a in (0, 30, 60)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    for c in range(3):
        own = points[[labels[f"{i:03d}"] == c for i in range(90)]]
        np.testing.assert_allclose(fit.centres[c], own.mean(axis=0), atol=1e-6)
    want = sum(((points[i] - fit.centres[labels[f"{i:03d}"]]) ** 2).sum() for i in range(90))
    assert fit.inertia == pytest.approx(want, rel=1e-6)
    same = spark.createDataFrame([(str(i), 1.0, 1.0) for i in range(6)], "stem string, x double, y double")
    assert clustering.kmeans(same, ["x", "y"], 3, restarts=2).inertia == 0
    ml = clustering.kmeans(df, ["x", "y"], 3, restarts=2, engine="mllib")
    assert ml.inertia == pytest.approx(fit.inertia, rel=1e-6)


# --- summaries -------------------------------------------------------------------


def test_finite_summary_and_large_path(spark, monkeypatch, rng):
    values = [float(v) for v in rng.random(500)] + [math.inf, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "g string, psnr_db double")
    for limit in (10**6, 0):
        monkeypatch.setattr(summaries, "BUFFER_ROWS", limit)
        rows = {r["g"]: r for r in summaries.finite_summary(df, ["g"], ["psnr_db"]).collect()}
        a, b = rows["a"], rows["b"]
        assert (a["count"], a["finite_count"], a["missing_count"]) == (502, 500, 2)
        assert a["median"] == pytest.approx(np.median(values[:500])) and a["mean"] == pytest.approx(np.mean(values[:500]))
        assert b["mean"] is None and b["median"] is None and b["missing_count"] == 1


def test_large_summaries_compute_their_metrics_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(x):
        calls.add(1)
        return x

    df = spark.range(500).select((F.col("id") % 2).alias("run"), scored(F.col("id").cast("double")).alias("ssim"))
    got = {r["run"]: r["median"] for r in summaries.finite_summary(df, ["run"], ["ssim"], buffer_rows=0).collect()}
    assert got == {0: 249.0, 1: 250.0} and calls.value == 500


def test_numpy_bootstrap_follows_the_seeded_stream(spark, rng):
    x = rng.random(37)
    df = spark.createDataFrame([(f"{i:02d}", float(v), 1.0) for i, v in enumerate(x)], "stem string, psnr_db double, ssim double")
    got = {r["metric"]: r for r in summaries.bootstrap_ci(df.repartition(5), [], ["psnr_db", "ssim"], 100, 11, "stream").collect()}
    draws = np.random.default_rng(11)
    want = np.quantile([draws.choice(x, size=37, replace=True).mean() for _ in range(100)], (0.025, 0.975))
    np.testing.assert_allclose([got["psnr_db"]["ci_lo"], got["psnr_db"]["ci_hi"]], want)
    assert got["ssim"]["ci_lo"] == got["ssim"]["ci_hi"] == 1.0
    none = summaries.bootstrap_ci(df, [], ["ssim"], 0).first()
    assert none["ci_lo"] is None


def test_stream_bootstrap_has_no_limit_and_the_same_draws(spark, rng, monkeypatch):
    from queries import metrics

    x, g = rng.normal(10, 2, 300), [None if i % 3 == 0 else "ab"[i % 2] for i in range(300)]
    x[5] = float("inf")
    rows = [(f"{i:03d}", k, k, float(v), float(v) / 2, float(v) / 3) for i, (k, v) in enumerate(zip(g, x))]
    df = spark.createDataFrame(rows, "stem string, split string, texture_cluster string, psnr_db double, ssim double, sobel_l1 double")
    monkeypatch.setattr(summaries, "DRAWS", 63)
    found = summaries.bootstrap_ci(df.repartition(5), ["split"], ["psnr_db", "ssim"], 30, 11, "stream").collect()
    got = {(r["split"], r["metric"]): (r["ci_lo"], r["ci_hi"]) for r in found}
    assert len(got) == 6
    for label in (None, "a", "b"):
        for offset, metric in enumerate(("psnr_db", "ssim")):
            draws = np.random.default_rng(11 + offset)
            values = np.array([v for r in rows if r[1] == label and math.isfinite(v := r[3 + offset])])
            want = np.quantile([draws.choice(values, size=len(values), replace=True).mean() for _ in range(30)], (0.025, 0.975))
            np.testing.assert_allclose(got[label, metric], want)

    class Views:
        met = df

    assert metrics.bootstrap_interval_numpy(Views()).count() == 6


def test_stream_bootstrap_over_several_blocks(spark, rng, monkeypatch):
    """Blocks of eight values and two replicates a task; drawn positions are never rows of a join."""
    for name, value in (("PACK_BITS", 1), ("BLOCK_BITS", 3), ("REPLICATES", 2), ("DRAWS", 7)):
        monkeypatch.setattr(summaries, name, value)
    x = rng.normal(10, 2, 45)
    df = spark.createDataFrame([(f"{i:02d}", None if i < 40 else "a", float(v)) for i, v in enumerate(x)], "stem string, split string, ssim double")
    found = summaries.bootstrap_ci(df.repartition(3), ["split"], ["ssim"], 9, 5, "stream")
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    got = {r["split"]: (r["ci_lo"], r["ci_hi"]) for r in found.collect()}
    for label, values in ((None, x[:40]), ("a", x[40:])):
        draws = np.random.default_rng(5)
        want = np.quantile([draws.choice(values, size=len(values), replace=True).mean() for _ in range(9)], (0.025, 0.975))
        np.testing.assert_allclose(got[label], want)


def test_index_bootstrap_over_several_blocks(spark, rng, monkeypatch):
    """Draws meet the values of their block; a draw is four bytes of an array and not a row."""
    from hashlib import md5

    for name, value in (("PACK_BITS", 1), ("INDEX_DRAWS", 16), ("DRAWS", 40)):
        monkeypatch.setattr(summaries, name, value)
    x = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.normal(10, 2, 45))]
    df = spark.createDataFrame([(f"{i:02d}", None if i < 40 else "a", v, float(i)) for i, v in enumerate(x)], "stem string, split string, psnr_db double, ssim double")
    found = summaries.bootstrap_ci(df.repartition(3), ["split"], ["psnr_db", "ssim"], 9, 5, "index")
    assert "explode(sequence(0, 8" not in found._jdf.queryExecution().toString()
    got = {(r["split"], r["metric"]): (r["ci_lo"], r["ci_hi"]) for r in found.collect()}
    alone = {r["metric"]: (r["ci_lo"], r["ci_hi"]) for r in summaries.bootstrap_ci(df.drop("split").filter("stem < '40'"), [], ["psnr_db", "ssim"], 9, 5, "index").collect()}
    for label, rows in ((None, range(40)), ("a", range(40, 45))):
        n = len(rows)
        hits = [[rows[int(int(md5(f"5:{b}:{i}".encode()).hexdigest()[:8], 16) / 2**32 * n)] for i in range(n)] for b in range(9)]
        for metric, value in (("psnr_db", x), ("ssim", list(map(float, range(45))))):
            means = [np.mean([value[i] for i in h if value[i] is not None]) for h in hits]
            np.testing.assert_allclose(got[label, metric], np.quantile(means, (0.025, 0.975)))
            if label is None:
                np.testing.assert_allclose(alone[metric], got[label, metric])


def test_poisson_bootstrap_agrees_with_resampling(spark, rng, monkeypatch):
    x = rng.normal(10, 2, 2000)
    df = spark.createDataFrame([(f"{i:05d}", float(v)) for i, v in enumerate(x)], "stem string, psnr_db double")
    row = summaries.bootstrap_ci(df, [], ["psnr_db"], 400, method="poisson").first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert row["ci_lo"] == pytest.approx(x.mean() - half, abs=0.3 * half)
    assert row["ci_hi"] == pytest.approx(x.mean() + half, abs=0.3 * half)
    again = summaries.bootstrap_ci(df.repartition(9), [], ["psnr_db"], 400, method="poisson").first()
    assert again["ci_lo"] == pytest.approx(row["ci_lo"], abs=1e-9)
    index = summaries.bootstrap_ci(df, [], ["psnr_db"], 400, method="index").first()
    assert index["ci_hi"] - index["ci_lo"] == pytest.approx(2 * half, rel=0.2)
    halves = rng.integers(0, 1 << 31, (2, 2000))
    w = summaries.poisson_weights(*halves, 50)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    monkeypatch.setattr(summaries, "HELD_SUMS", 1)
    monkeypatch.setattr(summaries, "DRAWN_WEIGHTS", 1000)
    grouped = df.withColumn("g", F.when(F.col("psnr_db") > 9, F.col("stem").substr(4, 1)))
    parts = {r["g"]: r for r in summaries.bootstrap_ci(grouped, ["g"], ["psnr_db"], 60).collect()}
    assert len(parts) == 11 and all(r["ci_lo"] < r["ci_hi"] for r in parts.values())
    with pytest.raises(ValueError, match="unknown"):
        summaries.bootstrap_ci(df, [], ["psnr_db"], 10, method="auto")


def test_scopes_use_the_documented_seeds(spark, rng):
    rows = [(f"{i:02d}", s, c, *[float(v) for v in rng.random(6)]) for i, (s, c) in enumerate([("train", "t1"), ("val", "t0")] * 12)]
    ddl = "stem string, split string, texture_cluster string, " + ", ".join(f"{m} double" for m in summaries.METRICS)
    df = spark.createDataFrame(rows, ddl)
    table = {(r["scope"], r["group_key"], r["metric"]): r for r in summaries.summarize_scopes(df, samples=20, seed=5, method="stream").collect()}
    assert len(table) == 6 * (1 + 2 + 2 + 1)

    def want(seed, values):
        draws = np.random.default_rng(seed)
        return np.quantile([draws.choice(values, size=len(values), replace=True).mean() for _ in range(20)], (0.025, 0.975))

    ssim = {s: np.array([r[4] for r in rows if r[1] == s]) for s in ("train", "val")}
    for key, seed, values in [(("by_split", "val", "ssim"), 5 + 200 + 1, ssim["val"]), (("by_texture_cluster", "t0", "ssim"), 5 + 1000 + 100 + 1, ssim["val"])]:
        np.testing.assert_allclose([table[key]["ci_lo"], table[key]["ci_hi"]], want(seed, values))


def test_paired_summary_denominators(spark):
    rows = [("p1", "s", "base", 1.0, 0.5, None), ("p1", "s", "cand", 2.0, 0.5, 0.1), ("p2", "s", "base", 1.0, 0.4, 0.2), ("p2", "s", "cand", 0.5, 0.6, 0.1)]
    df = spark.createDataFrame(rows, "relative_path string, severity string, method string, psnr_db double, ssim double, lpips_alex double")
    got = {r["metric"]: r for r in summaries.paired_summary(summaries.paired_deltas(df, "base", "cand")).collect()}
    assert got["psnr_db"]["win_rate"] == 0.5 and got["ssim"]["win_rate"] == 0.5 and got["lpips_alex"]["win_rate"] == 1.0
    assert got["lpips_alex"]["count"] == 2 and got["lpips_alex"]["finite_count"] == 1 and got["psnr_db"]["mean"] == pytest.approx(0.25)


def test_paired_deltas_keep_every_pair_of_a_repeated_key(spark):
    """Two baseline and two candidate rows under one key are four pairs, as in a join; a NULL key is a key."""
    ddl = "relative_path string, severity string, method string, psnr_db double, ssim double, lpips_alex double"
    rows = [(p, "s", m, 1.0 + (m == "cand") + i, 0.5, None if (m, i) == ("cand", 0) else 0.1 * i) for p in ("p", None) for m in ("base", "cand") for i in (0, 1)]
    deltas = summaries.paired_deltas(spark.createDataFrame([*rows, ("q", "s", "base", 1.0, 1.0, 1.0), ("r", "s", "cand", 1.0, 1.0, 1.0)], ddl), "base", "cand")
    for path in ("p", None):
        found = deltas.filter(F.col("relative_path").eqNullSafe(F.lit(path))).collect()
        assert sorted(r["delta_psnr_db"] for r in found) == [0.0, 1.0, 1.0, 2.0] and sum(r["win_psnr_db"] for r in found) == 3
        assert sorted(r["delta_lpips_alex"] for r in found if r["delta_lpips_alex"] is not None) == [0.0, 0.1]
    assert deltas.filter("relative_path = 'q'").first()["delta_ssim"] is None and deltas.filter("relative_path = 'r'").isEmpty()


@pytest.mark.parametrize("name", ["metric_direction", "paired_deltas", "paired_summary"])
def test_paired_queries_equal_their_sql_where_padded_keys_repeat(spark, tmp_path, name):
    """Part keys of seven digits are cut to six, so ten parts share a path."""
    import duckdb

    import __spark_entry__ as entry
    from tools.check_oracles import rows_of

    parts = [(1_000_000 + i, "Brand#1") for i in range(30)] + [(83 * i, "Brand#2") for i in range(5)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    frame = entry.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = db.execute(entry.oracle_sql()[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name, image", [("additive_noise_moments", 528), ("speckle_noise_moments", 12_375)])
def test_right_noise_is_never_called_wrong_by_chance(spark, tmp_path, name, image):
    """The 256 draws of this image alone lie more than four deviations off in their spread."""
    import __spark_entry__ as entry

    vectors = [(4 * image + i, [0.01 * i] * 64, "a") for i in range(4)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r["claim"], r["pixels"], r["centred"], r["spread_right"]) for r in rows) == [
        ("moved", 256, False, True), ("right", 256, True, True), ("wider", 256, True, False)
    ]


# --- training, restoring, scoring ---------------------------------------------------


@pytest.fixture
def pairs(images):
    rng = np.random.default_rng(3)
    high = {f"{i:02d}": np.clip(K.gaussian_blur(rng.random((1, 32, 32)), 1.0)[0] * 2 - 0.5, 0, 1) for i in range(14)}
    low = {k: K.resize_bicubic(v[None], 16, 16)[0] + rng.normal(0, 0.03, (16, 16)) for k, v in high.items()}
    n = F.col("stem").cast("int")
    return images(input=low, target=high).withColumn("split", F.when(n < 10, "train").otherwise("val_id")).withColumn("texture_cluster", F.lit("t"))


def test_profile_fit_and_training_rows(spark, pairs):
    profile = fit_profile(pairs, "m").first()["profile"].asDict(recursive=True)
    features = np.array([K.residual_features(pixels(r["input"])[None], pixels(r["target"])[None])[0] for r in pairs.filter("split = 'train'").collect()])
    low, high = np.clip(np.quantile(features[:, 0], (0.1, 0.9)) * 0.7, 0, 0.2)
    assert profile["gaussian_noise_std"] == pytest.approx({"low": low, "high": high})
    assert profile["fit_pair_count"] == 10 and profile["downsample_modes"] == ["area", "bicubic"]
    with pytest.raises(Exception, match="at least two"):
        fit_profile(pairs.filter("stem = '00'")).collect()
    with pytest.raises(ContractError, match="restricted"):
        fit_profile(pairs, split="val_id")

    rows = materialize_training(pairs, d4=True, synthetic_p=0.5, profile=profile, epochs=3)
    got = {(r["stem"], r["epoch"]): r for r in rows.collect()}
    again = {(r["stem"], r["epoch"]): r for r in materialize_training(pairs.repartition(5), True, 0.5, profile, 3).collect()}
    assert got == again and len(got) == 42
    source = {r["stem"]: r for r in pairs.collect()}
    for (stem, _), r in got.items():
        np.testing.assert_allclose(pixels(r["target"]), K.d4(pixels(source[stem]["target"]), r["transform"]), atol=1e-6)
        if not r["synthetic"]:
            np.testing.assert_allclose(pixels(r["input"]), K.d4(pixels(source[stem]["input"]), r["transform"]), atol=1e-6)
    assert 8 < sum(r["synthetic"] for r in got.values()) < 34 and len({r["transform"] for r in got.values()}) > 4
    with pytest.raises(ContractError, match="profile"):
        materialize_training(pairs, synthetic_p=0.1)
    with pytest.raises(ContractError):
        materialize_training(pairs, synthetic_p=1.5, profile=profile)


def test_residual_restorer_beats_bicubic_and_round_trips(spark, pairs):
    model, stats = fit_residual_restorer(pairs, patch=5)
    val = pairs.filter("split = 'val_id'")
    assert validate_predictor(val, model) > validate_predictor(val, Bicubic())
    loaded, provenance = load_model(model_table(spark, model, {"manifest_sha256": "m"}))
    np.testing.assert_allclose(loaded.weights, model.weights)
    assert provenance == {"manifest_sha256": "m"}
    broken = model_table(spark, model).withColumn("config", F.lit('{"patch": 3}'))
    with pytest.raises(ContractError, match="SHA-256"):
        load_model(broken)
    # Statistics are additive: two halves give the weights of the whole.
    train = pairs.filter("split = 'train'")
    _, first = fit_residual_restorer(train.filter("stem < '05'"), patch=5)
    resumed, _ = fit_residual_restorer(train.filter("stem >= '05'"), patch=5, statistics=first)
    np.testing.assert_allclose(resumed.weights, model.weights, atol=1e-8)
    taught, _ = fit_residual_restorer(pairs, patch=3, teacher=Bicubic(), teacher_weight=1.0)
    np.testing.assert_allclose(taught.weights, 0, atol=1e-9)
    for name, config in (("bicubic", {"x": 1}), ("nope", {}), ("residual", {"width": 3})):
        with pytest.raises(ContractError):
            create_predictor(name, config)


def test_evaluate_filters_before_scoring(spark, pairs):
    rows = evaluate(pairs, splits=["val_id"])
    assert rows.count() == 4 and set(r["split"] for r in rows.collect()) == {"val_id"}
    row = evaluate(pairs).filter("stem = '03'").first()
    source = pairs.filter("stem = '03'").first()
    want = K.image_metrics(K.resize_bicubic(pixels(source["input"])[None], 32, 32), pixels(source["target"])[None])
    assert row["ssim"] == pytest.approx(want["ssim"][0]) and row["psnr_db"] == pytest.approx(want["psnr_db"][0])
    scored = evaluate(pairs, perceptual=lambda p, t, normalize: np.abs(p - t).mean(axis=(1, 2, 3)))
    assert scored.filter("lpips_alex is null").count() == 0
    panel = panel_rows(evaluate(pairs), pairs, 2, Bicubic(), dtype="double").collect()
    assert len(panel) == 2 and panel[0]["bicubic"] == panel[0]["restored"]


def test_severity_grid(spark, images, rng):
    refs = images(image={f"c{i}/{i}.jpg": rng.random((24, 24)) for i in range(2)}).select(
        F.col("stem").alias("relative_path"), F.substring_index("stem", "/", 1).alias("defect_group"), "image")
    rows, summary, paired = severity_grid_eval(refs, {"bicubic": Bicubic(), "twice": Bicubic()}, samples=20, expected=2)
    assert rows.count() == 2 * 3 * 2 and summary.count() == 3 * 2 * 5
    assert all(r["mean"] == 0 and r["win_rate"] == 0 for r in paired.filter("metric != 'lpips_alex'").collect())
    row = rows.filter("relative_path = 'c1/1.jpg' and severity = 'profile_high' and method = 'bicubic'").first()
    image = pixels(refs.filter("relative_path = 'c1/1.jpg'").first()["image"])
    low = K.degrade(image, SEVERITIES["profile_high"], K.row_seed(2026, "profile_high", "c1/1.jpg"))
    want = K.image_metrics(K.resize_bicubic(low[None], 24, 24), image[None])
    assert row["psnr_db"] == pytest.approx(want["psnr_db"][0], rel=1e-6)
    with pytest.raises(ContractError, match="expected 5"):
        severity_grid_eval(refs, {"bicubic": Bicubic()}, expected=5)
    assert score_grid is not None


# --- decisions and runs ------------------------------------------------------------------

CASE = [
    ("baseline", "val_id", 28.0, 0.75, 0.30), ("baseline", "val_ood", 26.0, 0.65, 0.40),
    ("candidate", "val_id", 27.9, 0.749, 0.29), ("candidate", "val_ood", 26.2, 0.66, 0.37),
]


def summaries_of(spark, rows, manifest="m"):
    full = [(a, b, *v, manifest, a + "-c") for a, b, *v in rows]
    return spark.createDataFrame(full, "role string, split string, psnr_db double, ssim double, lpips_alex double, manifest_sha256 string, checkpoint_sha256 string")


def test_ablation_gate(spark):
    row = ablation_gate(summaries_of(spark, CASE), "exp", "change").first()
    assert row["decision"] == "keep" and row["ood_metric_wins"] == 3
    assert row["reason"] == "3 of 3 ranked metrics better out of distribution; in distribution PSNR moved -0.100000 dB and SSIM -0.001000"
    worse = [r if r[:2] != ("candidate", "val_id") else ("candidate", "val_id", 27.8, 0.749, 0.29) for r in CASE]
    assert ablation_gate(summaries_of(spark, worse), "exp", "change").first()["decision"] == "reject"
    mixed = summaries_of(spark, CASE[:3]).union(summaries_of(spark, CASE[3:], "other"))
    with pytest.raises(ContractError, match="same manifest"):
        ablation_gate(mixed, "exp", "change")
    new = ablation_gate(summaries_of(spark, CASE), "exp", "change")
    table = upsert_experiment(None, new)
    with pytest.raises(ContractError, match="already exists"):
        upsert_experiment(table, new)
    assert upsert_experiment(table, new, replace=True).count() == 1


def test_model_selection_breaks_the_tie_by_ood(spark):
    # Published scores of two candidates with equal mean rank.
    rows = [
        ("baseline", "val_id", 29.228288645604167, 0.7764908591691666, 0.2708827439618125),
        ("baseline", "val_ood", 25.244151621725415, 0.6645521163430427, 0.35236031924684597),
        ("conditioned", "val_id", 29.226240489125, 0.7765724780562501, 0.2714418435856459),
        ("conditioned", "val_ood", 25.251256508274583, 0.6660728102397031, 0.35307973583929503),
    ]
    df = spark.createDataFrame([(*r, "m") for r in rows], "name string, split string, psnr_db double, ssim double, lpips_alex double, manifest_sha256 string")
    got = {r["name"]: r for r in select_model(df).collect()}
    win = got["conditioned"]
    assert win["winner"] and win["mean_rank"] == 1.5 and win["id_mean_rank"] == pytest.approx(5 / 3) and win["ood_mean_rank"] == pytest.approx(4 / 3)
    with pytest.raises(ContractError, match="duplicate"):
        select_model(df.union(df.limit(1)))
    with pytest.raises(ContractError):
        select_model(df.withColumn("manifest_sha256", F.when(F.col("split") == "val_id", "x").otherwise("y")))


def test_run_comparison(spark):
    ddl = "tensor string, dtype string, shape array<int>, values array<double>"
    a = spark.createDataFrame([("w", "f", [2], [1.0, 2.0]), ("b", "f", [1], [0.5])], ddl)
    b = spark.createDataFrame([("w", "f", [2], [1.0, 2.25]), ("b", "f", [1], [0.25])], ddl)
    p = {"model_name": "n", "model_config": "{}", "manifest_sha256": "m"}
    same = compare_runs(a, a, p, p).first()
    assert same["passed"] and same["max_abs_diff"] == 0 and same["tensor"] is None
    diff = compare_runs(a, b, p, p, atol=0.1).first()
    assert not diff["passed"] and diff["max_abs_diff"] == 0.25 and diff["tensor"] == "b"
    with pytest.raises(ContractError, match="metadata"):
        compare_runs(a, b.withColumn("dtype", F.lit("g")), p, p)
    with pytest.raises(ContractError, match="keys differ"):
        compare_runs(a, b.filter("tensor = 'w'"), p, p)
    with pytest.raises(ContractError, match="manifest_sha256"):
        compare_runs(a, b, p, {**p, "manifest_sha256": "z"})


def test_running_best_across_blocks(spark, monkeypatch, rng):
    monkeypatch.setattr(tensors, "_BLOCK", 7)
    loss, psnr = rng.random(60), [float(v) if i % 4 == 0 else None for i, v in enumerate(rng.random(60))]
    df = spark.createDataFrame([("r", i, float(loss[i]), psnr[i]) for i in range(60)], "run string, step bigint, train_loss double, selected_val_psnr_db double")
    best, top = math.inf, None
    rows = tensors.running_best(df).orderBy("step").collect()
    for i, r in enumerate(rows):
        best = min(best, loss[i])
        new = psnr[i] is not None and (top is None or psnr[i] > top)
        top = max(x for x in (top, psnr[i]) if x is not None) if psnr[i] is not None or top is not None else None
        assert r["best_train_loss"] == best and r["is_new_best"] == new


def test_latency_nearest_rank(spark):
    values = [5.0, 1.0, 4.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("r", v, 16) for v in values], "run string, ms double, batch int")
    row = tensors.latency_summary(df).first()
    assert (row["median_ms"], row["p90_ms"], row["p95_ms"]) == (3.0, 5.0, 10.0)  # half-even ranks 2, 4, 5
    assert row["images_per_second"] == pytest.approx(16_000 / 3)


@pytest.mark.parametrize("buffer_rows", [250_000, 0])
def test_null_groups_survive_every_path(spark, buffer_rows):
    rows = [(None if i % 2 else "a", float(i), 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "run string, ms double, batch int")
    quantiles = {r["run"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["run"], "ms", [0.5], buffer_rows=buffer_rows).collect()}
    assert quantiles == {"a": (500, [499.0]), None: (500, [500.0])}
    summary = summaries.finite_summary(df.withColumnRenamed("ms", "ssim"), ["run"], ["ssim"], buffer_rows=buffer_rows)
    assert {r["run"]: r["median"] for r in summary.collect()} == {"a": 499.0, None: 500.0}
    latency = {r["run"]: r["median_ms"] for r in tensors.latency_summary(df, buffer_rows=buffer_rows).collect()}
    assert latency == {"a": 500.0, None: 501.0}


def test_intervals_and_win_rates_keep_null_groups(spark):
    rows = [(f"p{i}", None if i % 2 else "s", m, 20.0 + i + (m == "cand"), 0.5, 0.1) for i in range(40) for m in ("base", "cand")]
    df = spark.createDataFrame(rows, "relative_path string, severity string, method string, psnr_db double, ssim double, lpips_alex double")
    deltas = summaries.paired_deltas(df, "base", "cand")
    got = {(r["severity"], r["metric"]): r for r in summaries.paired_summary(deltas, samples=50).collect()}
    assert len(got) == 6 and got[(None, "psnr_db")]["win_rate"] == 1.0 and got[(None, "psnr_db")]["ci_lo"] == pytest.approx(1.0)


def test_kmeans_grid_is_the_same_for_every_table(spark):
    near = [(f"{i:03d}", float(i % 3) * 10 + i * 1e-6, 0.5) for i in range(60)]
    ddl = "stem string, a double, b double"
    few, many = spark.createDataFrame(near, ddl), spark.createDataFrame(near + [("far", 1e6, 0.5)], ddl)
    assert clustering._Points(few, ["a", "b"], "stem").unit == clustering._Points(many, ["a", "b"], "stem").unit == clustering.UNIT
    alone = {r["stem"]: r["distance2"] for r in clustering.kmeans(few, ["a", "b"], 3).assignments.collect()}
    beside = {r["stem"]: r["distance2"] for r in clustering.kmeans(many, ["a", "b"], 4, restarts=20).assignments.collect()}
    assert beside["far"] == 0 and all(beside[s] == pytest.approx(d, abs=1e-12) for s, d in alone.items())


def test_small_mends(spark):
    scores = spark.createDataFrame([("a", None), ("b", 3.0), ("c", float("inf")), ("d", 1.0)], "stem string, psnr_db double")
    assert [r["stem"] for r in selection.worst_k(scores, 3).collect()] == ["d", "b"]
    ddl = "tensor string, dtype string, shape array<int>, values array<double>"
    long, short = ([("t", "f", [2], v)] for v in ([1.0, 2.0], [1.0]))
    assert tensors.compare_tensors(spark.createDataFrame(long, ddl), spark.createDataFrame(short, ddl)).first()["error"] == "tensor metadata differs"
    with pytest.raises(Exception, match="at least two rows"):
        selection.hash_holdout(spark.createDataFrame([("a",)], "stem string")).collect()


def test_only_blocks_that_differ_are_compared(spark, rng):
    x = rng.normal(size=10_000)
    y, nan = x.copy(), x.copy()
    y[4097] += 0.5
    y[9999] -= 0.25
    nan[5] = float("nan")
    ddl = "tensor string, dtype string, shape array<int>, values array<double>"
    row = lambda name, v: (name, "f", [len(v)], v if v is None else [float(e) for e in v])
    left = spark.createDataFrame([row("same", x), row("moved", x), row("nan", nan), row("empty", []), ("none", "f", [0], None), row("sign", [0.0])], ddl)
    right = spark.createDataFrame([row("same", x), row("moved", y), row("nan", nan), row("empty", []), ("none", "f", [0], None), row("sign", [-0.0])], ddl)
    digests = [tensors.tensor_digests(t, 4096) for t in (left, right)]
    assert sorted(map(tuple, tensors.suspect_blocks(*digests).collect())) == [("moved", 1), ("moved", 2), ("nan", 0), ("sign", 0)]
    assert tensors.suspect_blocks(digests[0], digests[0]).filter("tensor <> 'nan'").isEmpty()
    found = {r["tensor"]: (r["error"], r["max_abs_diff"]) for r in tensors.compare_tensors(left, right).collect()}
    assert found["same"] == found["empty"] == found["none"] == found["sign"] == (None, 0.0)
    assert found["moved"] == (None, pytest.approx(0.5)) and math.isnan(found["nan"][1])
