"""End-to-end jobs over the views: splits, profiles, training rows, restoration, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtables import materialize
from imgtables.functions import pixels as P
from imgtables.functions.imaging import texture_descriptor
from imgtables.functions.restoring import Bicubic, load_model, model_table, predict
from imgtables.operators.clustering import kmeans, robust_scale
from imgtables.operators.summaries import summarize_scopes
from imgtables.plans import evaluate, fit_profile, fit_residual_restorer, materialize_training, panel_rows, severity_grid_eval
from imgtables.plans.restore import validate_predictor
from imgtables.plans.splits import label_texture_splits
from imgtables.schema import TEXTURE_FIELDS

from .pixels import RESIDUALS
from .registry import query, r

_UP_METRICS = """, cpx AS (SELECT u.stem, u.y, u.x, u.v AS raw, least(1, greatest(0, u.v))::DOUBLE AS p, least(1, greatest(0, t.v))::DOUBLE AS t
    FROM up u JOIN tpx t USING (stem, y, x)),
  sc AS (SELECT stem, -10 * log10(avg(pow(p - t, 2))) AS psnr_db, abs(avg(p) - avg(t)) AS bias,
    count(*) FILTER (raw < 0 OR raw > 1) / 256.0::DOUBLE AS oor FROM cpx GROUP BY 1) """


@query("evaluate_bicubic", "img lab tpx ipx w2 up", _UP_METRICS + f"""SELECT stem, split, texture_cluster, {r("psnr_db")} AS psnr_db,
  {r("bias")} AS mean_intensity_bias, {r("oor")} AS pre_clamp_out_of_range_rate, '16x16' AS prediction_shape FROM sc JOIN lab USING (stem)""")
def evaluate_bicubic(v):
    """Predict and score in one pass; SSIM and Sobel have their own pixel-SQL twins."""
    rows = evaluate(v.pairs)
    return rows.select(
        "stem", "split", "texture_cluster", "psnr_db", "mean_intensity_bias", "pre_clamp_out_of_range_rate", "prediction_shape"
    )


@query("evaluate_summary", "img lab tpx ipx w2 up", _UP_METRICS + f""", m AS (SELECT * FROM sc JOIN lab USING (stem)),
  wk AS (SELECT ceil(count(*) * 0.1::DOUBLE)::BIGINT AS k FROM m),
  s AS (SELECT 'all' AS scope, '' AS group_key, psnr_db FROM m UNION ALL SELECT 'by_split', split, psnr_db FROM m
    UNION ALL SELECT 'by_texture_cluster', texture_cluster, psnr_db FROM m
    UNION ALL (SELECT 'worst_psnr_decile', '', psnr_db FROM m ORDER BY psnr_db, stem LIMIT (SELECT k FROM wk)))
  SELECT scope, group_key, count(*) AS count, {r("avg(psnr_db)")} AS mean, {r("median(psnr_db)")} AS median FROM s GROUP BY ALL""")
def evaluate_summary(v):
    rows = materialize(evaluate(v.pairs))
    table = summarize_scopes(rows, names=["psnr_db"])
    return table.select("scope", "group_key", "count", "mean", "median")


@query("texture_ood_split")
def texture_ood_split(v):
    """Cluster holdout labels; k-means has no SQL form, invariants are unit-tested."""
    labels, _, _ = label_texture_splits(v.pairs, "target", cluster_count=6)
    return labels


@query("texture_split_sizes", "img", """SELECT count(*) AS pair_count,
    round_even(count(*) * 0.15::DOUBLE, 0)::BIGINT AS val_id, 0::BIGINT AS broken_clusters, count(*) AS labelled FROM img""")
def texture_split_sizes(v):
    """What must hold for any clusters: exact in-distribution quota, whole held-out clusters, a label for every image."""
    labels, _, details = label_texture_splits(v.pairs, "target", cluster_count=6)
    labels = materialize(labels)
    mixed = labels.groupBy("texture_cluster").agg(
        F.count(F.when(F.col("split") == "val_ood", 1)).alias("held"), F.count("*").alias("n")
    ).filter("held > 0 and held < n")
    sizes = labels.agg(F.count(F.when(F.col("split") == "val_id", 1)).alias("val_id"), F.count("split").alias("labelled"))
    return sizes.select(
        F.lit(details["pair_count"]).cast("bigint").alias("pair_count"), "val_id",
        F.lit(mixed.count()).cast("bigint").alias("broken_clusters"), "labelled",
    )


@query("texture_clusters")
def texture_clusters(v):
    table = materialize(v.pairs.select("stem", texture_descriptor("target").alias("d")).select("stem", "d.*"))
    scaled, _, _ = robust_scale(table, TEXTURE_FIELDS)
    return kmeans(scaled, TEXTURE_FIELDS, 4).assignments


@query("texture_clusters_mllib")
def texture_clusters_mllib(v):
    table = materialize(v.pairs.select("stem", texture_descriptor("target").alias("d")).select("stem", "d.*"))
    scaled, _, _ = robust_scale(table, TEXTURE_FIELDS)
    return kmeans(scaled, TEXTURE_FIELDS, 4, restarts=2, max_iter=20, engine="mllib").assignments


def _range_sql(value: str, name: str, factor: float, cap: float) -> str:
    def end(p):
        return f"least(greatest(0, quantile_cont({value}, {p}) * {factor}), {cap})"

    return f"{r(end(0.1))} AS {name}_low, {r(f'greatest({end(0.1)}, {end(0.9)})')} AS {name}_high"


@query("fit_degradation_profile", "img lab tpx ipx wh down", RESIDUALS + f""", f AS (SELECT sd, mn, mad,
    least(1.5, greatest(0, (1 - gs / greatest(gb, 1e-8)) * 1.5)) AS blur
    FROM ga JOIN sp USING (stem) JOIN lab USING (stem) WHERE split = 'train')
  SELECT count(*) AS fit_pair_count, {_range_sql("blur", "blur", 1.0, 1.5)}, {_range_sql("sd", "gaussian", 0.7, 0.2)},
    {_range_sql("mad", "speckle", 0.3, 0.3)}, {r("quantile_cont(mn, 0.1)")} AS bias_low, {r("quantile_cont(mn, 0.9)")} AS bias_high FROM f""")
def fit_degradation_profile(v):
    """Quantile ranges of the residual features of the training pairs."""
    return fit_profile(v.pairs).select("profile.*").select(
        "fit_pair_count", F.col("blur_sigma.low").alias("blur_low"), F.col("blur_sigma.high").alias("blur_high"),
        F.col("gaussian_noise_std.low").alias("gaussian_low"), F.col("gaussian_noise_std.high").alias("gaussian_high"),
        F.col("speckle_std.low").alias("speckle_low"), F.col("speckle_std.high").alias("speckle_high"),
        F.col("additive_bias.low").alias("bias_low"), F.col("additive_bias.high").alias("bias_high"),
    )


@query("training_rows")
def training_rows(v):
    profile = fit_profile(v.pairs).first()["profile"].asDict(recursive=True)  # one row
    train = v.pairs.filter("split = 'train'")
    rows = materialize_training(train, d4=True, synthetic_p=0.5, profile=profile, epochs=2)
    return rows.select("stem", "epoch", "transform", "synthetic", P.image_stats("input.pixels").alias("s")).select(
        "stem", "epoch", "transform", "synthetic", "s.*"
    )


_U = "(('0x' || substr(md5({}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


@query("training_draws", "img lab", f"""SELECT stem, e::INT AS epoch, floor({_U.format("'2026:d4:' || e || ':' || stem")} * 8)::INT AS transform,
  {_U.format("'2026:synthetic:' || e || ':' || stem")} < 0.25 AS synthetic, round(list_avg(target), 4) + 0 AS target_mean
  FROM img JOIN lab USING (stem), (SELECT unnest(range(3)) AS e) WHERE split = 'train'""")
def training_draws(v):
    """Transform and Bernoulli draws per epoch; the mean survives any dihedral transform."""
    flat = {"low": 0.0, "high": 0.0}
    profile = {"blur_sigma": flat, "gaussian_noise_std": flat, "speckle_std": flat, "additive_bias": flat, "downsample_modes": ["area"]}
    rows = materialize_training(v.pairs.filter("split = 'train'"), True, 0.25, profile, epochs=3)
    mean = P.image_stats("target.pixels")["mean"]
    return rows.select("stem", "epoch", "transform", "synthetic", F.round(mean, 4).alias("target_mean"))


@query("restore_bicubic", "img ipx w2 up", f"SELECT stem, (y * 16 + x)::INT AS i, {r('least(1, greatest(0, v))')} AS v FROM up")
def restore_bicubic(v):
    out = v.pairs.select("stem", predict("input", Bicubic(), "double", clip=True).alias("o"))
    return out.select("stem", F.posexplode("o.pixels").alias("i", "v"))


@query("residual_restorer")
def residual_restorer(v):
    """Fit on train, pass through the model table, score both predictors on every split."""
    model, _ = fit_residual_restorer(v.pairs, patch=3)
    model, _ = load_model(model_table(v.spark, model))
    learned = evaluate(v.pairs, model).groupBy("split").agg(F.avg("psnr_db").alias("residual_psnr_db"))
    plain = evaluate(v.pairs).groupBy("split").agg(F.avg("psnr_db").alias("bicubic_psnr_db"))
    val = validate_predictor(v.pairs.filter("split = 'val_id'"), model)
    return learned.join(plain, "split").withColumn("val_psnr_db", F.lit(val))


@query("residual_normal_equations", "img lab ipx tpx w2 up", f""", f AS (
    SELECT i.v AS x, t.v - u.v AS gap, (u.y % 2) * 2 + u.x % 2 AS d FROM up u
    JOIN ipx i ON i.stem = u.stem AND i.y = u.y // 2 AND i.x = u.x // 2
    JOIN tpx t ON t.stem = u.stem AND t.y = u.y AND t.x = u.x
    JOIN lab ON lab.stem = u.stem WHERE split = 'train'),
  p AS (SELECT d, sum(x * x) AS xx, sum(x) AS sx, count(*)::DOUBLE AS n, sum(x * gap) AS xg, sum(gap) AS sg FROM f GROUP BY d),
  c AS (SELECT 0 AS i, 0 AS j, xx AS value FROM p WHERE d = 0 UNION ALL SELECT 0, 1, sx FROM p WHERE d = 0
    UNION ALL SELECT 1, 0, sx FROM p WHERE d = 0 UNION ALL SELECT 1, 1, n FROM p WHERE d = 0
    UNION ALL SELECT 0, 2 + d, xg FROM p UNION ALL SELECT 1, 2 + d, sg FROM p)
  SELECT i::INT AS i, j::INT AS j, round(value, 4) + 0 AS value FROM c""")
def residual_normal_equations(v):
    """The sums that the residual restorer is solved from, for single-pixel neighbourhoods."""
    _, sums = fit_residual_restorer(v.pairs, patch=1)
    return sums.withColumn("value", F.round("value", 4))


@query("severity_grid_scores", "img tpx wh down w2", """, h AS (SELECT stem, y, w2.o AS x, sum(v * w) AS v FROM down JOIN w2 ON down.x = w2.i GROUP BY 1, 2, 3),
  up2 AS (SELECT stem, w2.o AS y, x, sum(v * w) AS v FROM h JOIN w2 ON h.y = w2.i GROUP BY 1, 2, 3)""" + f"""
  SELECT stem AS relative_path, {r("-10 * log10(avg(pow(least(1, greatest(0, u.v)) - t.v, 2)))")} AS psnr_db
  FROM up2 u JOIN tpx t USING (stem, y, x) GROUP BY 1""")
def severity_grid_scores(v):
    """Grid evaluation of whole images; the noise-free bicubic cell has a pixel-SQL twin."""
    refs = v.pairs.select(F.col("stem").alias("relative_path"), F.col("texture_cluster").alias("defect_group"), F.col("target").alias("image"))
    rows, _, _ = severity_grid_eval(refs, {"bicubic": Bicubic()})
    return rows.filter("severity = 'downsample_only'").select("relative_path", "psnr_db")


@query("severity_grid_paired")
def severity_grid_paired(v):
    refs = v.pairs.select(F.col("stem").alias("relative_path"), F.col("texture_cluster").alias("defect_group"), F.col("target").alias("image"))
    model, _ = fit_residual_restorer(v.pairs, patch=3)
    _, _, paired = severity_grid_eval(refs, {"bicubic": Bicubic(), "candidate": model}, samples=100)
    return paired


@query("panel_rows", "img tpx ipx w2 up", _UP_METRICS + f""", k AS (SELECT stem, psnr_db FROM sc ORDER BY psnr_db, stem LIMIT 6)
  SELECT k.stem, {r("psnr_db")} AS psnr_db, {r("sum(u.v)")} AS restored_sum, {r("list_sum(any_value(target))")} AS target_sum
  FROM k JOIN up u USING (stem) JOIN img USING (stem) GROUP BY k.stem, psnr_db""")
def panel(v):
    metrics = materialize(evaluate(v.pairs).select("stem", "psnr_db"))
    rows = panel_rows(metrics, v.pairs, 6, Bicubic(), dtype="double")

    def total(c):
        return F.aggregate(f"{c}.pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))

    return rows.select("stem", "psnr_db", total("restored").alias("restored_sum"), total("target").alias("target_sum"))
