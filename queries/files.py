"""Files written by the sinks and read back by the sources, below the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from imgtables.functions.imaging import make_image
from imgtables.plans import build_manifest, decisions
from imgtables.schema import LOWER_IS_BETTER, MANIFEST_FIELDS, METRICS, RANKED_METRICS
from imgtables.session import checkpoint_root
from imgtables.sinks import read_version, write_json, write_metrics
from imgtables.sources import load_pairs, read_manifest, read_pairs, register_sources

from .registry import query, r


def _folder(v) -> str:
    return f"{checkpoint_root(v.spark)}/files-{uuid.uuid4().hex}"


@query("npy_round_trip", "", f"""SELECT lpad(vec_id::VARCHAR, 8, '0') AS stem, 128 + 4 * len(embedding) AS length, 1 AS height,
    len(embedding) AS width, 'float32' AS src_dtype, {r("list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE))")} AS total,
    {r("list_min(embedding)::FLOAT::DOUBLE")} AS lowest
  FROM embeddings WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)""")
def npy_round_trip(v):
    """Every vector as an array file of one row: one committing write, one read by ranges of names."""
    folder = _folder(v)
    register_sources(v.spark)
    whole = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    vectors = v.table("embeddings").filter(whole).select(
        F.concat(F.lit("v/"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".npy")).alias("relpath"),
        make_image(F.lit(1), F.size("embedding"), F.col("embedding").cast("array<float>")).alias("image"),
    )
    vectors.write.format("imgtables_npy").mode("append").save(folder)
    read = v.spark.read.format("imgtables_npy").option("probe", "500").load(folder)
    total = F.aggregate("image.pixels", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read.select(
        F.substring("relpath", 3, 8).alias("stem"), "length", "image.height", "image.width", "src_dtype", total.alias("total"),
        F.array_min("image.pixels").cast("double").alias("lowest"),
    )


@query("npy_names", "", """SELECT lpad(vec_id::VARCHAR, 8, '0') AS stem, 128 + 4 * len(embedding) AS length FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND vec_id::VARCHAR LIKE '%5' AND lpad(vec_id::VARCHAR, 8, '0') >= '00000100'""")
def npy_names(v):
    """Names and sizes alone: folders and ranges outside the filter are not listed, and no file is opened."""
    folder = _folder(v)
    register_sources(v.spark)
    whole = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    name = F.lpad(F.col("vec_id").cast("string"), 8, "0")
    v.table("embeddings").filter(whole).select(
        F.concat(F.lit("d"), F.right(name, F.lit(1)), F.lit("/"), name, F.lit(".npy")).alias("relpath"),
        make_image(F.lit(1), F.size("embedding"), F.col("embedding").cast("array<float>")).alias("image"),
    ).write.format("imgtables_npy").mode("append").save(folder)
    read = v.spark.read.format("imgtables_npy").schema("relpath string, length bigint").load(folder)
    return read.filter("relpath like 'd5/%' and relpath >= 'd5/00000100'").select(F.substring("relpath", 4, 8).alias("stem"), "length")


@query("metrics_round_trip", "met", "SELECT stem, split, texture_cluster, " + ", ".join(f"format('{{:.10g}}', {m}) AS {m}" for m in METRICS) + " FROM met")
def metrics_round_trip(v):
    """Per-image metrics through the text sink: ten digits, blanks for missing values."""
    folder = _folder(v)
    write_metrics(v.met, folder, format="csv")
    read = v.spark.read.option("header", "true").option("escape", '"').csv(folder)
    return read.select("stem", "split", "texture_cluster", *METRICS)


@query("json_round_trip", "met", f"""SELECT count(*) AS pair_count, count(*) FILTER (isfinite(psnr_db)) AS finite,
    {r("avg(ssim)")} AS mean_ssim, min(stem) AS first_stem, max(split) AS last_split FROM met""")
def json_round_trip(v):
    """A report of one row as sorted JSON, whose digest is that of the file read back."""
    path = f"{_folder(v)}.json"
    finite = F.col("psnr_db").isNotNull() & (F.abs("psnr_db") < float("inf"))
    digest = write_json(v.met.agg(
        F.count("*").alias("pair_count"), F.count(F.when(finite, 1)).alias("finite"), F.avg("ssim").alias("mean_ssim"),
        F.min("stem").alias("first_stem"), F.max("split").alias("last_split"),
    ), path)
    same = v.spark.read.format("binaryFile").load(path).filter(F.sha2("content", 256) == digest).select(F.col("path").alias("_p"))
    read = v.spark.read.option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("_p"))
    return read.join(same.select(F.regexp_replace("_p", "^file:/+", "/").alias("_q")), F.regexp_replace("_p", "^file:/+", "/") == F.col("_q")).select(
        "pair_count", "finite", "mean_ssim", "first_stem", "last_split"
    )


# --- jobs from files --------------------------------------------------------------------------


def _summary_files(v) -> dict:
    """Every candidate's two metric summaries as JSON files: ``{name: (id path, ood path)}``; two dozen small files."""
    folder, paths = _folder(v), {}
    for row in v.cand.collect():
        path = f"{folder}/{row['name']}-{row['split']}.json"
        means = {m: {"mean": row[m], "median": row[m], "bootstrap_95_ci": [], "finite_count": 1, "non_finite_or_missing_count": 0} for m in RANKED_METRICS}
        write_json({
            "manifest_sha256": row["manifest_sha256"], "checkpoint_sha256": row["checkpoint_sha256"], "model": row["name"],
            "aggregates": {"all": {"count": 1, **means}},
        }, path)
        paths.setdefault(row["name"], {})[row["split"]] = path
    return {name: (found["val_id"], found["val_ood"]) for name, found in sorted(paths.items())}


_DELTAS = ", ".join(
    f"round(max(CASE WHEN c.split = '{s}' THEN c.{m} - b.{m} END), 6) + 0 AS {tag}_{short}"
    for s, tag in (("val_id", "id"), ("val_ood", "ood"))
    for m, short in (("psnr_db", "psnr_delta_db"), ("ssim", "ssim_delta"), ("lpips_alex", "lpips_delta"))
)


@query("ablation_record", "met cand", f""", g AS (SELECT c.name, max(b.checkpoint_sha256) AS baseline_checkpoint_sha256, max(c.checkpoint_sha256) AS candidate_checkpoint_sha256,
    max(c.manifest_sha256) AS manifest_sha256, {_DELTAS},
    max(CASE WHEN c.split = 'val_ood' THEN (c.psnr_db > b.psnr_db)::INT + (c.ssim > b.ssim)::INT + (c.lpips_alex < b.lpips_alex)::INT END) AS ood_metric_wins,
    bool_and(c.split <> 'val_id' OR (c.psnr_db - b.psnr_db >= -0.15 AND c.ssim - b.ssim >= -0.002)) AS safe
  FROM cand c JOIN cand b ON b.name = 'texture_01' AND b.split = c.split WHERE c.name IN ('texture_02', 'texture_03', 'texture_04') GROUP BY 1)
  SELECT name AS experiment, CASE WHEN name = 'texture_02' THEN 'second' ELSE 'first' END AS isolated_change, g.* EXCLUDE (name, safe),
    -0.15::DOUBLE AS id_psnr_floor_db, -0.002::DOUBLE AS id_ssim_floor, CASE WHEN safe AND ood_metric_wins >= 2 THEN 'keep' ELSE 'reject' END AS decision,
    CASE WHEN name = 'texture_02' THEN 4 ELSE 3 END AS versions FROM g""")
def ablation_record(v):
    """Three candidates gated from summary files into one versioned table, the first of them a second time; its older version stays readable."""
    files, table = _summary_files(v), _folder(v)
    base = files["texture_01"]
    for name, change in (("texture_02", "first"), ("texture_03", "first"), ("texture_04", "first"), ("texture_02", "second")):
        decisions.record_ablation(v.spark, *base, *files[name], table, experiment=name, isolated_change=change, replace=change == "second")
    newest, before = read_version(v.spark, table), read_version(v.spark, table, 3)
    known = before.select("experiment", F.col("isolated_change").alias("_was"))
    return newest.join(known, "experiment").withColumn(
        "versions", F.when(F.col("_was") == F.col("isolated_change"), 3).otherwise(4)
    ).drop("_was", "reason")


_RANKS = ", ".join(f"rank() OVER (PARTITION BY split ORDER BY {m}{'' if m in LOWER_IS_BETTER else ' DESC'}) AS k_{m}" for m in RANKED_METRICS)
_SIDES = ", ".join(
    f"max(CASE WHEN split = '{s}' THEN {m} END) AS {tag}_{m}, max(CASE WHEN split = '{s}' THEN k_{m} END) AS {tag}_rank_{m}"
    for s, tag in (("val_id", "id"), ("val_ood", "ood")) for m in RANKED_METRICS
)


@query("selection_report", "met cand", f""", k AS (SELECT *, {_RANKS} FROM cand), w AS (SELECT name, {_SIDES}, any_value(checkpoint_sha256) AS checkpoint_sha256,
    any_value(manifest_sha256) AS manifest_sha256 FROM k GROUP BY name),
  o AS (SELECT *, (id_rank_psnr_db + id_rank_ssim + id_rank_lpips_alex) / 3.0::DOUBLE AS i, (ood_rank_psnr_db + ood_rank_ssim + ood_rank_lpips_alex) / 3.0::DOUBLE AS u FROM w),
  z AS (SELECT *, row_number() OVER (ORDER BY (i + u) / 2.0, u, i, name) AS selection_order FROM o)
  SELECT z.* EXCLUDE (i, u), {r("i")} AS id_mean_rank, {r("u")} AS ood_mean_rank, {r("(i + u) / 2.0")} AS mean_rank, selection_order = 1 AS winner FROM z""")
def selection_report(v):
    """Twelve candidates ranked from their summary files, with all scores and ranks."""
    return decisions.select_from_files(v.spark, _summary_files(v), f"{_folder(v)}.json")


@query("manifest_job", "", """WITH n AS (SELECT lpad(vec_id::VARCHAR, 8, '0') AS stem, list_transform(embedding, lambda x: x::FLOAT) AS e FROM embeddings WHERE len(embedding) = 64)
  SELECT stem, 'a/train/' || stem || '.npy' AS input_relpath, 'b/train/' || stem || '.npy' AS target_relpath, '4x4' AS input_shape, '8x8' AS target_shape,
    round(list_min(e[1:16])::DOUBLE, 6) + 0 AS input_min, round(list_max(e)::DOUBLE, 6) + 0 AS target_max, round(list_sum(list_transform(e, lambda x: x::DOUBLE)), 6) + 0 AS total FROM n""")
def manifest_job(v):
    """Pairs of two folders of the same name: the manifest's paths lead back to both files."""
    folder = _folder(v)
    register_sources(v.spark)
    vectors = v.table("embeddings").filter(F.size("embedding") == 64)
    name = F.concat(F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".npy"))
    pixels = F.col("embedding").cast("array<float>")
    for side, image in (("a", make_image(F.lit(4), F.lit(4), F.slice(pixels, 1, 16))), ("b", make_image(F.lit(8), F.lit(8), pixels))):
        vectors.select(name.alias("relpath"), image.alias("image")).write.format("imgtables_npy").mode("append").save(f"{folder}/{side}/train")
    build_manifest(v.spark, f"{folder}/a/train", f"{folder}/b/train", f"{folder}/manifest", f"{folder}/audit.json")
    rows = read_manifest(v.spark, f"{folder}/manifest").withColumn("split", F.lit("train"))
    rows.select(*MANIFEST_FIELDS).write.option("header", "true").csv(f"{folder}/with_split")
    pairs = load_pairs(read_pairs(v.spark, f"{folder}/with_split", folder, "train"))
    total = pairs.select("stem", F.aggregate("target.pixels", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))
    return rows.select(
        "stem", "input_relpath", "target_relpath", "input_shape", "target_shape", F.col("input_min").cast("double").alias("input_min"),
        F.col("target_max").cast("double").alias("target_max"),
    ).join(total, "stem")
