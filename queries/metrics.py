"""Summaries, rankings, selections and decision tables over metric and run views."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtables import materialize
from imgtables.functions import columns as C
from imgtables.operators import selection, summaries, tensors
from imgtables.operators.clustering import kmeans
from imgtables.operators.quantiles import clipped_range, exact_quantiles
from imgtables.plans import decisions, runs
from imgtables.plans.training import profile_from_quantiles

from .registry import query, r

_M = "psnr_db ssim lpips_alex sobel_l1 mean_intensity_bias pre_clamp_out_of_range_rate".split()


def _summary_sql(keys: str, source: str) -> str:
    head = keys + ", " if keys else ""
    return f"""SELECT {head}metric, count(*) AS count, {r("avg(CASE WHEN isfinite(value) THEN value END)")} AS mean,
    {r("quantile_cont(CASE WHEN isfinite(value) THEN value END, 0.5)")} AS median,
    count(*) FILTER (isfinite(value)) AS finite_count, count(*) FILTER (NOT isfinite(value)) AS missing_count
  FROM {source} GROUP BY ALL"""


@query("finite_summary", "met metl", _summary_sql("", "metl"))
def finite_summary(v):
    return summaries.finite_summary(v.met, [])


@query("finite_summary_by_split", "met metl", _summary_sql("split", "metl"))
def finite_summary_by_split(v):
    return summaries.finite_summary(v.met, ["split"])


_SCOPES = """, wk AS (SELECT greatest(1, ceil((SELECT count(*) FROM met) * 0.1::DOUBLE))::BIGINT AS k),
  worst AS (SELECT stem FROM met WHERE isfinite(psnr_db) ORDER BY psnr_db, stem LIMIT (SELECT k FROM wk)),
  sc AS (SELECT 'all' AS scope, '' AS group_key, stem, metric, value FROM metl
    UNION ALL SELECT 'by_split', split, stem, metric, value FROM metl
    UNION ALL SELECT 'by_texture_cluster', texture_cluster, stem, metric, value FROM metl
    UNION ALL SELECT 'worst_psnr_decile', '', stem, metric, value FROM metl WHERE stem IN (SELECT stem FROM worst)) """


@query("scope_summaries", "met metl", _SCOPES + _summary_sql("scope, group_key", "sc"))
def scope_summaries(v):
    return summaries.summarize_scopes(materialize(v.met)).drop("ci_lo", "ci_hi")


@query("worst_decile", "met", """SELECT stem FROM met WHERE isfinite(psnr_db) ORDER BY psnr_db, stem
  LIMIT (SELECT greatest(1, ceil(count(*) * 0.1::DOUBLE))::BIGINT FROM met)""")
def worst_decile(v):
    return selection.worst_fraction(materialize(v.met.select("stem", "psnr_db"))).select("stem")


@query("worst_decile_with_ties", "", """WITH m AS (SELECT stem, floor(psnr_db) AS psnr_db FROM (
    SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS stem, (o_custkey % 5)::DOUBLE AS psnr_db FROM orders))
  SELECT stem FROM m ORDER BY psnr_db, stem LIMIT (SELECT ceil(count(*) * 0.1::DOUBLE)::BIGINT FROM m)""")
def worst_decile_with_ties(v):
    """One value holds a fifth of all rows; the tie is cut by stem."""
    rows = v.table("orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("stem"), (F.col("o_custkey") % 5).cast("double").alias("psnr_db")
    )
    return selection.worst_fraction(rows).select("stem")


_POISSON = ", ".join(f"WHEN x < {step} THEN {w}" for w, step in enumerate(summaries.POISSON_STEPS)).replace(", WHEN", " WHEN")
_MASK = (1 << 31) - 1


def _mix_sql(source: str, out: str, column: str, keep: str) -> str:
    """One scrambling round in SQL, in steps, so each intermediate is named once."""
    return f"""{out}_1 AS (SELECT {keep}, ({column} * 73244475) & {_MASK} AS x FROM {source}),
  {out}_2 AS (SELECT {keep}, xor(x, x >> 15) AS x FROM {out}_1),
  {out}_3 AS (SELECT {keep}, (x * 668265261) & {_MASK} AS x FROM {out}_2),
  {out} AS (SELECT {keep}, xor(x, x >> 13) AS x FROM {out}_3)"""


def _bootstrap_sql(samples: int) -> str:
    keep = "split, psnr_db, ssim, h2, b"
    return f""", h AS (SELECT split, CASE WHEN isfinite(psnr_db) THEN psnr_db END AS psnr_db, ssim,
    ('0x' || substr(md5('2026:' || stem), 1, 8))::BIGINT & {_MASK} AS h1,
    ('0x' || substr(md5('2026:' || stem), 9, 8))::BIGINT & {_MASK} AS h2 FROM met),
  e AS (SELECT *, xor(h1, (b * 40503) & {_MASK}) AS x0 FROM h, (SELECT unnest(range({samples})) AS b)),
  {_mix_sql("e", "f", "x0", keep)},
  f2 AS (SELECT {keep}, xor(x, h2) AS x0 FROM f), {_mix_sql("f2", "g", "x0", keep)},
  w AS (SELECT *, CASE {_POISSON} ELSE {len(summaries.POISSON_STEPS)} END AS w FROM g),
  s AS (SELECT split, b, sum(w * psnr_db) / sum(CASE WHEN psnr_db IS NOT NULL THEN w END) AS psnr_db,
    sum(w * ssim) / sum(w) AS ssim FROM w WHERE w > 0 GROUP BY ALL),
  l AS (UNPIVOT s ON psnr_db, ssim INTO NAME metric VALUE value)
  SELECT split, metric, {r("quantile_cont(value, 0.025)")} AS ci_lo, {r("quantile_cont(value, 0.975)")} AS ci_hi FROM l GROUP BY ALL"""


@query("bootstrap_interval", "met", _bootstrap_sql(200))
def bootstrap_interval(v):
    return summaries.bootstrap_ci(v.met, ["split"], ["psnr_db", "ssim"], samples=200, method="poisson")


_INDEX = f""", n AS (SELECT split, psnr_db, ssim, row_number() OVER (PARTITION BY split ORDER BY stem) - 1 AS i,
    count(*) OVER (PARTITION BY split) AS n FROM (SELECT split, stem, CASE WHEN isfinite(psnr_db) THEN psnr_db END AS psnr_db, ssim FROM met)),
  d AS (SELECT split, b, floor((('0x' || substr(md5('2026:' || b || ':' || i), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE) * n)::BIGINT AS j
    FROM n, (SELECT unnest(range(40)) AS b)),
  s AS (SELECT d.split, b, avg(psnr_db) AS psnr_db, avg(ssim) AS ssim FROM d JOIN n ON n.split = d.split AND n.i = d.j GROUP BY ALL),
  l AS (UNPIVOT s ON psnr_db, ssim INTO NAME metric VALUE value)
  SELECT split, metric, {r("quantile_cont(value, 0.025)")} AS ci_lo, {r("quantile_cont(value, 0.975)")} AS ci_hi FROM l GROUP BY ALL"""


@query("bootstrap_interval_index", "met", _INDEX)
def bootstrap_interval_index(v):
    """Exactly n hash-drawn rows per replicate and group."""
    return summaries.bootstrap_ci(v.met, ["split"], ["psnr_db", "ssim"], samples=40, method="index")


@query("bootstrap_interval_numpy")
def bootstrap_interval_numpy(v):
    """Row-by-row seeded resampling per texture cluster (a NumPy stream, not SQL)."""
    return summaries.bootstrap_ci(v.met, ["split", "texture_cluster"], ["psnr_db", "ssim"], samples=200, method="stream")


@query("bootstrap_numpy_bounds", "met", f""", l AS (UNPIVOT (SELECT split, ssim, sobel_l1 FROM met) ON ssim, sobel_l1 INTO NAME metric VALUE value)
  SELECT split, metric, {r("avg(value)")} AS mean, count(*) AS n, stddev_pop(value) > 0 AS inside, stddev_pop(value) > 0 AS normal_width
  FROM l GROUP BY ALL""")
def bootstrap_numpy_bounds(v):
    """The resampled interval holds the mean and is as wide as the normal one, give or take a quarter."""
    names = ["ssim", "sobel_l1"]
    found = summaries.bootstrap_ci(v.met, ["split"], names, samples=400, method="stream")
    facts = summaries.long_metrics(v.met, ["split"], names).groupBy("split", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"), F.count("*").alias("n")
    )
    width = (F.col("ci_hi") - F.col("ci_lo")) / (2 * 1.96 * F.col("s") / F.sqrt("n"))
    return facts.join(found, ["split", "metric"]).select(
        "split", "metric", "mean", "n", F.col("mean").between(F.col("ci_lo"), F.col("ci_hi")).alias("inside"), width.between(0.75, 1.25).alias("normal_width")
    )


@query("severity_method_summary", "grid", f""", l AS (UNPIVOT (SELECT severity, method, psnr_db, ssim, coalesce(lpips_alex, 'nan'::DOUBLE) AS lpips_alex,
    sobel_l1, mean_intensity_bias FROM grid) ON psnr_db, ssim, lpips_alex, sobel_l1, mean_intensity_bias INTO NAME metric VALUE value)
  {_summary_sql("severity, method", "l")}""")
def severity_method_summary(v):
    return summaries.finite_summary(v.grid, ["severity", "method"], _M[:5])


_DELTA = """, d AS (SELECT b.relative_path, b.severity, c.psnr_db - b.psnr_db AS delta_psnr_db, c.ssim - b.ssim AS delta_ssim,
    c.lpips_alex - b.lpips_alex AS delta_lpips_alex FROM (SELECT * FROM grid WHERE method = 'bicubic') b
  JOIN (SELECT * FROM grid WHERE method = 'candidate') c USING (relative_path, severity)) """


@query("paired_deltas", "grid", _DELTA + f"""SELECT relative_path, severity, {r("delta_psnr_db")} AS delta_psnr_db, {r("delta_ssim")} AS delta_ssim,
  {r("delta_lpips_alex")} AS delta_lpips_alex FROM d""")
def paired_deltas(v):
    return summaries.paired_deltas(v.grid, "bicubic", "candidate").drop("win_psnr_db", "win_ssim", "win_lpips_alex")


@query("paired_summary", "grid", _DELTA + f""", l AS (UNPIVOT (SELECT severity, delta_psnr_db AS psnr_db, delta_ssim AS ssim,
    coalesce(delta_lpips_alex, 'nan'::DOUBLE) AS lpips_alex FROM d) ON psnr_db, ssim, lpips_alex INTO NAME metric VALUE value)
  SELECT severity, metric, count(*) AS count, {r("avg(CASE WHEN isfinite(value) THEN value END)")} AS mean,
    {r("quantile_cont(CASE WHEN isfinite(value) THEN value END, 0.5)")} AS median, count(*) FILTER (isfinite(value)) AS finite_count,
    {r("avg(CASE WHEN isfinite(value) THEN (CASE WHEN metric = 'lpips_alex' THEN value < 0 ELSE value > 0 END)::INT END)")} AS win_rate
  FROM l GROUP BY ALL""")
def paired_summary(v):
    table = summaries.paired_summary(summaries.paired_deltas(v.grid, "bicubic", "candidate"))
    return table.select("severity", "metric", "count", "mean", "median", "finite_count", "win_rate")


@query("delta_extremes", "grid", _DELTA + f"""SELECT severity, {r("min(delta_psnr_db)")} AS min_value, arg_min(relative_path, delta_psnr_db) AS min_label,
  {r("max(delta_psnr_db)")} AS max_value, arg_max(relative_path, delta_psnr_db) AS max_label FROM d GROUP BY severity""")
def delta_extremes(v):
    return selection.extremes(summaries.paired_deltas(v.grid, "bicubic", "candidate"), ["severity"])


@query("profile_quantile_ranges", "grid", f"""SELECT severity, {r("least(greatest(0, quantile_cont(sobel_l1, 0.1) * 0.7), 0.2)")} AS low,
  {r("greatest(least(greatest(0, quantile_cont(sobel_l1, 0.1) * 0.7), 0.2), least(greatest(0, quantile_cont(sobel_l1, 0.9) * 0.7), 0.2))")} AS high
  FROM grid GROUP BY 1""")
def profile_quantile_ranges(v):
    q = exact_quantiles(v.grid, ["severity"], "sobel_l1", [0.1, 0.9])
    return q.select("severity", clipped_range(F.col("q"), 0.7, 0.2).alias("s")).select("severity", "s.*")


@query("bracketed_quantiles", "", f"""SELECT l_returnflag, count(*) AS n, {r("quantile_cont(l_extendedprice, 0.1)")} AS q10,
  {r("quantile_cont(l_extendedprice, 0.5)")} AS q50, {r("quantile_cont(l_extendedprice, 0.9)")} AS q90 FROM lineitem GROUP BY 1""")
def bracketed_quantiles(v):
    """The large-group path of the exact quantiles, forced on the biggest table."""
    q = exact_quantiles(v.table("lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9], buffer_rows=0)
    return q.select("l_returnflag", "n", *[F.element_at("q", i + 1).alias(a) for i, a in enumerate(("q10", "q50", "q90"))])


@query("robust_scaling", "met", f"""SELECT {r("quantile_cont(ssim, 0.5)")} AS ssim_centre, {r("quantile_cont(ssim, 0.75) - quantile_cont(ssim, 0.25)")} AS ssim_scale,
  {r("quantile_cont(sobel_l1, 0.5)")} AS sobel_centre, 1.0::DOUBLE AS flat_scale,
  {r("avg((ssim - (SELECT quantile_cont(ssim, 0.5) FROM met)) / (SELECT quantile_cont(ssim, 0.75) - quantile_cont(ssim, 0.25) FROM met))")} AS scaled_mean FROM met""")
def robust_scaling(v):
    from imgtables.operators.clustering import robust_scale

    scaled, centre, scale = robust_scale(v.met.withColumn("flat", F.lit(3.0)), ["ssim", "sobel_l1", "flat"])
    return scaled.agg(F.avg("ssim").alias("scaled_mean")).select(
        F.lit(centre["ssim"]).alias("ssim_centre"), F.lit(scale["ssim"]).alias("ssim_scale"),
        F.lit(centre["sobel_l1"]).alias("sobel_centre"), F.lit(scale["flat"]).alias("flat_scale"), "scaled_mean",
    )


_NEAR = "list_sort(list(ms))[(round_even((count(*) - 1) * {p}::DOUBLE, 0))::INT + 1]"


@query("latency_report", "lat", f"""SELECT run, {r("avg(ms)")} AS mean_ms, max(batch) AS batch, count(*) AS n,
  {r(_NEAR.format(p=0.5))} AS median_ms, {r(_NEAR.format(p=0.9))} AS p90_ms, {r(_NEAR.format(p=0.95))} AS p95_ms,
  {r("max(batch) * 1000.0 / " + _NEAR.format(p=0.5))} AS images_per_second FROM lat GROUP BY run""")
def latency_report(v):
    return runs.latency_report(v.lat)


_TENS = """, d AS (SELECT a.tensor, list_max(list_transform(range(1, 65), lambda i: abs(a.vals[i] - b.vals[i]))) AS diff
  FROM (SELECT * FROM tens WHERE run = 'a') a JOIN (SELECT * FROM tens WHERE run = 'b') b USING (tensor)) """


@query("tensor_comparison", "tens", _TENS + f"SELECT tensor, NULL::VARCHAR AS error, {r('diff')} AS max_abs_diff FROM d")
def tensor_comparison(v):
    return tensors.compare_tensors(v.tens("a"), v.tens("b"))


@query("run_comparison", "tens", _TENS + f""", m AS (SELECT max(round(diff, 9)) AS top FROM d)
  SELECT {r("max(diff)")} AS max_abs_diff, (SELECT min(tensor) FROM d, m WHERE round(diff, 9) = top) AS tensor, 0::BIGINT AS errors, false AS passed FROM d""")
def run_comparison(v):
    compared = tensors.compare_tensors(v.tens("a"), v.tens("b"))
    rounded = compared.withColumn("max_abs_diff", F.round("max_abs_diff", 9))
    return tensors.max_difference(rounded, atol=1e-4)


@query("validation_psnr", "img", f"""SELECT {r('''avg(-10 * log10(greatest(list_avg(list_transform(range(1, 257), lambda i:
  pow(least(1, greatest(0, target[i])) - 0.5, 2))), 1e-12)))''')} AS val_psnr_db FROM img""")
def validation_psnr(v):
    from imgtables.functions import pixels as P

    flat = F.transform("target", lambda x: F.lit(0.5))
    return tensors.validation_psnr(v.img.select(P.mse(P.clamp01("target"), flat).alias("mse")))


@query("history_running_best", "hist", f"""SELECT run, step, {r("min(train_loss) OVER (PARTITION BY run ORDER BY step)")} AS best_train_loss,
  coalesce(selected_val_psnr_db > max(selected_val_psnr_db) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    selected_val_psnr_db IS NOT NULL) AS is_new_best FROM hist""")
def history_running_best(v):
    return tensors.running_best(v.hist).select("run", "step", "best_train_loss", "is_new_best")


_NULL_KEYS = """, q AS (SELECT CASE WHEN split <> 'val_ood' THEN split END AS split, psnr_db, ssim FROM met) """


def _null_keys(v):
    """A third of the rows has no key."""
    return v.met.select(F.when(F.col("split") != "val_ood", F.col("split")).alias("split"), "psnr_db", "ssim")


@query("null_key_quantiles", "met", _NULL_KEYS + f"""SELECT way, split, count(*) AS n, {r("quantile_cont(ssim, 0.1)")} AS low,
  {r("quantile_cont(ssim, 0.5)")} AS middle FROM q, (VALUES ('sorted'), ('bracketed')) w(way) GROUP BY ALL""")
def null_key_quantiles(v):
    rows = materialize(_null_keys(v))
    parts = [
        exact_quantiles(rows, ["split"], "ssim", [0.1, 0.5], **how)
        .select(F.lit(way).alias("way"), "split", "n", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("middle"))
        for way, how in (("sorted", {}), ("bracketed", {"buffer_rows": 0}))
    ]
    return parts[0].unionByName(parts[1])


@query("null_key_summary", "met", _NULL_KEYS + f""", l AS (
    SELECT split, 'psnr_db' AS metric, coalesce(psnr_db, 'nan'::DOUBLE) AS value FROM q UNION ALL SELECT split, 'ssim', ssim FROM q),
  s AS ({_summary_sql("split", "l")}) SELECT way, s.* FROM s, (VALUES ('sorted'), ('bracketed')) w(way)""")
def null_key_summary(v):
    rows = materialize(_null_keys(v))
    parts = [
        summaries.finite_summary(rows, ["split"], ["psnr_db", "ssim"], **how).withColumn("way", F.lit(way))
        for way, how in (("sorted", {}), ("bracketed", {"buffer_rows": 0}))
    ]
    return parts[0].unionByName(parts[1])


@query("history_report", "hist", f"""SELECT run, max(step) AS steps, {r("arg_min(train_loss, step)")} AS initial_train_loss,
  {r("arg_max(train_loss, step)")} AS final_train_loss, {r("min(train_loss)")} AS best_train_loss,
  {r("min(train_loss) / arg_min(train_loss, step)")} AS loss_reduction_ratio, {r("max(selected_val_psnr_db)")} AS best_val_psnr_db,
  arg_max(step, selected_val_psnr_db) AS best_step FROM hist GROUP BY run""")
def history_report(v):
    chosen = v.hist.withColumn("selected_weights", C.select_weights("raw_val_psnr_db", "ema_val_psnr_db"))
    return runs.history_report(chosen).drop("best_weights_source")


@query("weight_source_choice", "hist", """SELECT step, CASE WHEN raw_val_psnr_db IS NULL THEN NULL WHEN ema_val_psnr_db > raw_val_psnr_db THEN 'ema' ELSE 'raw' END
  AS selected_weights FROM hist""")
def weight_source_choice(v):
    return v.hist.select("step", C.select_weights("raw_val_psnr_db", "ema_val_psnr_db").alias("selected_weights"))


# --- allocation, ranks, decisions -------------------------------------------------------


def _clusters(v):
    return v.met.groupBy((F.col("texture_cluster").substr(9, 2).cast("int")).alias("cluster")).agg(
        F.count("*").alias("size"), F.round(F.avg("ssim"), 9).alias("distance")
    )


_CLUSTERS = ", cl AS (SELECT substr(texture_cluster, 9, 2)::INT AS cluster, count(*) AS size, round(avg(ssim), 9) AS distance FROM met GROUP BY 1) "


@query("ood_cluster_pick", "met", _CLUSTERS + f""", t AS (SELECT round_even((SELECT count(*) FROM met) * 0.15::DOUBLE, 0)::BIGINT AS target),
  w AS (SELECT *, row_number() OVER (ORDER BY distance DESC, cluster) AS pos, sum(size) OVER (ORDER BY distance DESC, cluster) AS upto FROM cl),
  s AS (SELECT *, pos > 1 AND (upto - size >= target OR abs(upto - size - target) <= abs(upto - target)) AS stop FROM w, t)
  SELECT cluster, size, {r("distance")} AS distance, NOT bool_or(stop) OVER (ORDER BY distance DESC, cluster) AS ood FROM s""")
def ood_cluster_pick(v):
    table = _clusters(v)
    return selection.pick_ood_clusters(table, round(v.met.count() * 0.15))


@query("largest_remainder_quotas", "met", _CLUSTERS + """, t AS (SELECT round_even(sum(size) * 0.15::DOUBLE, 0)::BIGINT AS target, sum(size) AS total FROM cl),
  b AS (SELECT cluster, size, size * (target / total) AS share, least(size - 1, floor(size * (target / total)))::BIGINT AS base, target FROM cl, t),
  k AS (SELECT *, row_number() OVER (ORDER BY share - base DESC, cluster) AS pos, target - sum(base) OVER () AS extra FROM b)
  SELECT cluster, size, (base + CASE WHEN pos <= extra THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")
def largest_remainder_quotas(v):
    table = _clusters(v).select("cluster", "size")
    return selection.largest_remainder(table, round(v.met.count() * 0.15))


@query("competition_ranks", "met cand", """SELECT name, split, rank() OVER (PARTITION BY split ORDER BY psnr_db DESC) AS rank_psnr_db,
  rank() OVER (PARTITION BY split ORDER BY ssim DESC) AS rank_ssim, rank() OVER (PARTITION BY split ORDER BY lpips_alex) AS rank_lpips_alex FROM cand""")
def competition_ranks(v):
    return decisions.rank_candidates(v.cand)


@query("candidate_join", "met cand", f"""SELECT i.name, {r("i.psnr_db")} AS id_psnr_db, {r("i.ssim")} AS id_ssim, {r("i.lpips_alex")} AS id_lpips_alex,
  {r("o.psnr_db")} AS ood_psnr_db, {r("o.ssim")} AS ood_ssim, {r("o.lpips_alex")} AS ood_lpips_alex
  FROM (SELECT * FROM cand WHERE split = 'val_id') i JOIN (SELECT * FROM cand WHERE split = 'val_ood') o USING (name)""")
def candidate_join(v):
    return decisions.join_candidates(v.cand)


@query("model_selection", "met cand", f""", k AS (SELECT name, split, (rank() OVER (PARTITION BY split ORDER BY psnr_db DESC)
    + rank() OVER (PARTITION BY split ORDER BY ssim DESC) + rank() OVER (PARTITION BY split ORDER BY lpips_alex)) / 3.0::DOUBLE AS m FROM cand),
  p AS (SELECT name, max(CASE WHEN split = 'val_id' THEN m END) AS i, max(CASE WHEN split = 'val_ood' THEN m END) AS o FROM k GROUP BY 1),
  z AS (SELECT *, row_number() OVER (ORDER BY (i + o) / 2.0, o, i, name) AS selection_order FROM p)
  SELECT name, {r("i")} AS id_mean_rank, {r("o")} AS ood_mean_rank, {r("(i + o) / 2.0")} AS mean_rank, selection_order, selection_order = 1 AS winner FROM z""")
def model_selection(v):
    return decisions.select_model(v.cand)


@query("ablation_gate", "met cand", f""", g AS (SELECT c.name, max(CASE WHEN c.split = 'val_id' THEN c.psnr_db - b.psnr_db END) AS p,
    max(CASE WHEN c.split = 'val_id' THEN c.ssim - b.ssim END) AS s,
    max(CASE WHEN c.split = 'val_ood' THEN (c.psnr_db > b.psnr_db)::INT + (c.ssim > b.ssim)::INT + (c.lpips_alex < b.lpips_alex)::INT END) AS wins
  FROM cand c JOIN cand b ON b.name = 'texture_01' AND b.split = c.split WHERE c.name <> 'texture_01' GROUP BY 1)
  SELECT name, {r("p")} AS id_psnr_delta_db, {r("s")} AS id_ssim_delta, wins AS ood_metric_wins,
    CASE WHEN p >= -0.15 AND s >= -0.002 AND wins >= 2 THEN 'keep' ELSE 'reject' END AS decision FROM g""")
def ablation_gate(v):
    """Every texture cluster as a candidate against the same baseline."""
    base = F.broadcast(v.cand.filter("name = 'texture_01'").drop("name"))  # two rows
    names = v.cand.filter("name <> 'texture_01'")
    metrics = ("psnr_db", "ssim", "lpips_alex")
    candidate = names.select("name", "split", F.lit("candidate").alias("role"), *metrics)
    baseline = names.select("name", "split").join(base, "split").select("name", "split", F.lit("baseline").alias("role"), *metrics)
    table = decisions.gate_rows(candidate.unionByName(baseline), keys=["name"])
    return table.select("name", "id_psnr_delta_db", "id_ssim_delta", "ood_metric_wins", "decision")


@query("precision_gate", "lat", f""", m AS (SELECT run, avg(ms) AS full_ms, quantile_cont(ms, 0.4) AS alt_ms FROM lat GROUP BY 1)
  SELECT run, {r("(full_ms - alt_ms) / full_ms * 100")} AS speedup_percent, (full_ms - alt_ms) / full_ms * 100 >= 10 AS use_alternative FROM m""")
def precision_gate(v):
    q = exact_quantiles(v.lat, ["run"], "ms", [0.4]).select("run", F.element_at("q", 1).alias("alt_ms"))
    both = v.lat.groupBy("run").agg(F.avg("ms").alias("full_ms")).join(q, "run")
    return both.select("run", *decisions.precision_gate(F.col("full_ms"), F.col("alt_ms"), F.lit(True)))


@query("student_gate", "", """WITH m AS (SELECT p_brand, avg(p_size) AS t, min(p_size) + 10 AS s, (avg(p_retailprice) - 1400) / 1000 AS d FROM part GROUP BY 1)
  SELECT p_brand, CASE WHEN (t - s) / t * 100 >= 25 AND d >= -0.15 THEN 'accept' ELSE 'reject' END AS decision FROM m""")
def student_gate(v):
    rows = v.table("part").groupBy("p_brand").agg(
        F.avg("p_size").alias("t"), (F.min("p_size") + 10).alias("s"), ((F.avg("p_retailprice") - 1400) / 1000).alias("d")
    )
    gate = decisions.student_gate(F.col("t"), F.col("s"), F.col("d"), F.col("d"))
    return rows.select("p_brand", gate.alias("decision"))


@query("stable_order", "man", "SELECT stem FROM man ORDER BY stem")
def stable_order(v):
    return selection.stable_order(v.man.select("stem"))


@query("global_rank", "met", "SELECT stem, row_number() OVER (ORDER BY ssim DESC, stem) - 1 AS _rank FROM met")
def global_rank(v):
    return selection.global_rank(v.met.select("stem", "ssim"), F.desc("ssim"), "stem").select("stem", F.col("_rank").alias("_rank"))


@query("first_n_pairs", "man", "SELECT stem FROM man ORDER BY stem LIMIT 32")
def first_n_pairs(v):
    return selection.first_n(v.man.select("stem"), 32)


@query("worst_k_rows", "met", f"SELECT stem, {r('psnr_db')} AS psnr_db FROM met WHERE isfinite(psnr_db) ORDER BY psnr_db, stem LIMIT 8")
def worst_k_rows(v):
    return selection.worst_k(v.met.filter(C.is_finite("psnr_db")).select("stem", "psnr_db"), 8)


@query("intensity_bins", "img", f""", m AS (SELECT stem, list_avg(input) AS mean FROM img)
  SELECT least(9, greatest(0, floor(mean * 10)))::INT AS bin, count(*) AS count, {r("avg(mean)")} AS mean FROM m GROUP BY 1""")
def intensity_bins(v):
    from imgtables.functions import pixels as P

    mean = v.img.select("stem", P.image_stats("input")["mean"].alias("mean"))
    label = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("mean") * 10))).cast("int")
    table = summaries.finite_summary(mean.withColumn("bin", label), ["bin"], ["mean"])
    return table.select("bin", "count", "mean")


@query("profile_assembly", "grid", f"""SELECT {r("least(greatest(0, quantile_cont(sobel_l1, 0.1)), 1.5)")} AS blur_low,
  {r("least(greatest(0, quantile_cont(ssim, 0.9) * 0.7), 0.2)")} AS gaussian_high, {r("quantile_cont(mean_intensity_bias, 0.1)")} AS bias_low,
  {r("least(greatest(0, quantile_cont(pre_clamp_out_of_range_rate, 0.1) * 0.3), 0.3)")} AS speckle_low FROM grid""")
def profile_assembly(v):
    names = {"residual_std": "ssim", "residual_mean": "mean_intensity_bias", "speckle_mad": "pre_clamp_out_of_range_rate", "blur_proxy": "sobel_l1"}
    long = summaries.long_metrics(v.grid.select(*[F.col(c).alias(k) for k, c in names.items()]), [], list(names))
    q = exact_quantiles(long.withColumnRenamed("metric", "feature"), ["feature"], "value", [0.1, 0.9])
    return profile_from_quantiles(q).select(
        F.col("profile.blur_sigma.low").alias("blur_low"), F.col("profile.gaussian_noise_std.high").alias("gaussian_high"),
        F.col("profile.additive_bias.low").alias("bias_low"), F.col("profile.speckle_std.low").alias("speckle_low"),
    )


_START = [(0.1, 0.2), (0.4, 0.9), (0.8, 0.3), (0.9, 0.8)]


def _lloyd_sql(steps: int) -> str:
    values = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_START))
    sql = f"WITH pt AS MATERIALIZED (SELECT lpad(p_partkey::VARCHAR, 8, '0') AS stem, p_size / 50.0::DOUBLE AS a, (p_partkey % 97) / 97.0::DOUBLE AS b FROM part), c0 AS (SELECT * FROM (VALUES {values}) v(c, a, b))"
    for i in range(steps + 1):
        sql += f""", n{i} AS MATERIALIZED (SELECT stem, any_value(p.a) AS a, any_value(p.b) AS b, arg_min(c.c, (p.a - c.a) ** 2 + (p.b - c.b) ** 2) AS c,
    min((p.a - c.a) ** 2 + (p.b - c.b) ** 2) AS d FROM pt p, c{i} c GROUP BY stem), c{i + 1} AS (SELECT c, avg(a) AS a, avg(b) AS b FROM n{i} GROUP BY c)"""
    return sql + f" SELECT stem, c::INT AS cluster, {r('d')} AS distance2 FROM n{steps}"


@query("lloyd_steps", "", _lloyd_sql(3))
def lloyd_steps(v):
    """Three Lloyd steps from given centres: labels and squared distances."""
    points = v.table("part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("stem"), (F.col("p_size") / 50.0).alias("a"),
        ((F.col("p_partkey") % 97) / 97.0).alias("b"),
    )
    return kmeans(points, ["a", "b"], 4, max_iter=3, initial=_START).assignments
