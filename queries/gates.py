"""Scans, paths, digests, gates, joins and splits over file and manifest views."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from imgtables.functions import columns as C
from imgtables.functions import pixels as P
from imgtables.operators import checks, pairing, summaries
from imgtables.operators.selection import hash_holdout, stratified_holdout, take_quota
from imgtables.plans.manifest import dataset_audit
from imgtables.plans.runs import output_violations
from imgtables.sinks.writers import digest_rows, render_manifest, upserted
from imgtables.sources.images import require_even
from imgtables.sources.tables import checked_pairs, label_columns, profile_error, summary_means, summary_schema

from .registry import query, r

_NOISE = "(list_contains(string_split(relpath, '/'), '__MACOSX') OR starts_with(regexp_extract(relpath, '[^/]*$'), '._'))"


@query("archive_noise", "files", f"SELECT side, relpath, {_NOISE} AS ignored FROM files")
def archive_noise(v):
    return v.files.select("side", "relpath", C.is_archive_noise("relpath").alias("ignored"))


@query("ignored_count", "files", f"SELECT side, count(*) AS ignored FROM files WHERE {_NOISE} GROUP BY side")
def ignored_count(v):
    noisy = v.files.filter(C.is_archive_noise("relpath"))
    return noisy.groupBy("side").agg(F.count("*").alias("ignored"))


@query("image_contract", "img", """SELECT stem,
  CASE WHEN stem::INT % 7 = 0 THEN 'contains NaN or infinity' WHEN stem::INT % 11 = 0 THEN 'pixel count differs from shape'
       WHEN stem::INT % 13 = 0 THEN 'empty image' END AS error FROM img""")
def image_contract(v):
    """Spoil known rows in three ways; the contract must name exactly those."""
    n = F.col("stem").cast("int")
    not_finite = F.transform("input", lambda x: F.when(x > 0.5, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    spoiled = v.img.select(
        "stem",
        F.when(n % 7 == 0, 8).when(n % 11 == 0, 9).when(n % 13 == 0, 0).otherwise(8).alias("h"),
        F.lit(8).alias("w"),
        F.when(n % 7 == 0, not_finite).otherwise(F.col("input")).alias("px"),
    )
    return spoiled.select("stem", P.image_error("h", "w", "px").alias("error"))


@query("even_size_gate", "", """WITH s AS (SELECT page_id, 10 + page_id % 9 AS h, 12 + 2 * (page_id % 5) AS w FROM pages)
  SELECT page_id::VARCHAR AS relative_path, CASE WHEN least(h, w) < 12 OR h % 2 <> 0 OR w % 2 <> 0
    THEN 'expected even sides of at least 12' END AS error FROM s""")
def even_size_gate(v):
    h, w = (F.lit(10) + F.col("page_id") % 9).cast("int"), (F.lit(12) + 2 * (F.col("page_id") % 5)).cast("int")
    image = F.struct(h.alias("height"), w.alias("width"))
    rows = v.table("pages").select(F.col("page_id").cast("string").alias("relative_path"), image.alias("image"))
    return require_even(rows, mode="quarantine").select("relative_path", "error")


@query("training_pairs_of_split", "man", """SELECT stem, input_relpath, target_relpath, 'train' AS split,
  CASE WHEN starts_with(target_relpath, '../') THEN 'path escapes the dataset root' END AS error
  FROM man WHERE trim(split) = 'train'""")
def training_pairs_of_split(v):
    return checked_pairs(v.man, "train")


@query("label_reader", "man", """SELECT stem, coalesce(nullif(trim(split), ''), 'unassigned') AS split,
  coalesce(nullif(trim(texture_cluster), ''), 'unassigned') AS texture_cluster FROM man""")
def label_reader(v):
    return label_columns(v.man)


@query("summary_reader", "met", f"""SELECT split AS name, 'm' AS manifest_sha256,
  {r("avg(CASE WHEN isfinite(psnr_db) THEN psnr_db END)")} AS psnr_db, {r("avg(ssim)")} AS ssim, {r("avg(lpips_alex)")} AS lpips_alex
  FROM met GROUP BY 1""")
def summary_reader(v):
    """Metric summaries as nested JSON text, read back with an explicit schema."""
    finite = F.avg(F.when(C.is_finite("psnr_db"), F.col("psnr_db")))
    means = v.met.groupBy(F.col("split").alias("name")).agg(finite.alias("p"), F.avg("ssim").alias("s"), F.avg("lpips_alex").alias("l"))

    def block(c):
        return F.struct(F.col(c).alias("mean"))

    whole = F.struct(block("p").alias("psnr_db"), block("s").alias("ssim"), block("l").alias("lpips_alex"))
    text = F.to_json(F.struct(F.lit("m").alias("manifest_sha256"), F.struct(whole.alias("all")).alias("aggregates")))
    parsed = means.select("name", F.from_json(text, summary_schema()).alias("j")).select("name", "j.*")
    return summary_means(parsed.drop("checkpoint_sha256"))


@query("profile_validation", "", """WITH p AS (SELECT p_partkey, p_size / 100.0 AS lo, p_size / 100.0 + (p_partkey % 5 - 1) / 10.0 AS hi FROM part)
  SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unsupported schema' WHEN hi < lo THEN 'invalid range blur_sigma'
    WHEN p_partkey % 7 = 0 THEN 'invalid range speckle_std' WHEN p_partkey % 13 = 0 THEN 'invalid range additive_bias'
    WHEN p_partkey % 17 = 0 THEN 'invalid downsample_modes' END AS error FROM p""")
def profile_validation(v):
    key = F.col("p_partkey")

    def span(low, high):
        ends = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
        return F.struct(*[x.cast("double").alias(n) for n, x in zip(("low", "high"), ends)])

    low = F.col("p_size") / 100.0
    profile = F.struct(
        F.when(key % 11 == 0, 2).otherwise(1).alias("schema_version"),
        span(low, low + (key % 5 - 1) / 10.0).alias("blur_sigma"),
        span(0.0, 0.1).alias("gaussian_noise_std"),
        F.when(key % 7 == 0, span(-0.1, 0.1)).otherwise(span(0.0, 0.1)).alias("speckle_std"),
        F.when(key % 13 == 0, span(0.2, 0.1)).otherwise(span(-0.1, 0.1)).alias("additive_bias"),
        F.when(key % 17 == 0, F.array(F.lit("nearest"))).otherwise(F.array(F.lit("area"), F.lit("bicubic"))).alias("downsample_modes"),
    )
    return v.table("part").select("p_partkey", profile.alias("profile")).select("p_partkey", profile_error("profile").alias("error"))


@query("experiment_upsert", "met cand", """SELECT name AS experiment, split AS isolated_change, psnr_db AS id_psnr_delta_db,
  CASE WHEN name = 'texture_03' THEN 'new' ELSE 'old' END AS decision FROM cand WHERE split = 'val_id'""")
def experiment_upsert(v):
    base = v.cand.filter("split = 'val_id'").select(
        F.col("name").alias("experiment"), F.col("split").alias("isolated_change"), F.col("psnr_db").alias("id_psnr_delta_db")
    )
    old = base.withColumn("decision", F.lit("old"))
    new = base.filter("experiment = 'texture_03'").withColumn("decision", F.lit("new"))
    return upserted(old, new)


@query("path_parts", "files", """SELECT side, relpath, regexp_extract(relpath, '[^/]*$') AS name,
  regexp_replace(regexp_extract(relpath, '[^/]*$'), '\\.npy$', '') AS stem, split_part(relpath, '/', 1) AS parent FROM files""")
def path_parts(v):
    full = v.files.select("side", F.concat(F.lit("/data/"), "relpath").alias("path"))
    return C.with_path_parts(full, "path", "/data").select("side", "relpath", "name", "stem", "parent")


@query("casefold_order", "files", "SELECT relpath, lower(relpath) || '/strasse' AS key FROM files WHERE side = 'input'")
def casefold_order(v):
    """Stable scan order by full case folding, which turns a sharp s into two letters."""
    keyed = v.files.filter("side = 'input'").select("relpath", C.casefold_key(F.concat("relpath", F.lit("/Straße"))).alias("key"))
    return keyed.orderBy("key")


@query("path_collisions", "", """SELECT lower(u) AS key, count(*) AS count, min(u) AS first, max(u) AS last
  FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END || '/' || p_partkey // 3 AS u FROM part)
  GROUP BY 1 HAVING count(*) > 1""")
def path_collisions(v):
    folder = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type"))
    number = F.floor(F.col("p_partkey") / 3).cast("string")
    rows = v.table("part").select(F.concat(folder, F.lit("/"), number).alias("u"))
    return checks.path_collisions(rows, "u")


@query("path_safety", "man files", """SELECT m.stem, CASE WHEN starts_with(target_relpath, '../') THEN 'path escapes the dataset root'
    WHEN f.relpath IS NULL THEN 'file does not exist' END AS error
  FROM man m LEFT JOIN (SELECT DISTINCT 'gt/' || stem || '.npy' AS relpath FROM files WHERE side = 'target') f
    ON m.target_relpath = f.relpath""")
def path_safety(v):
    listing = v.files.filter("side = 'target'").select(F.concat(F.lit("gt/"), C.stem(F.col("relpath")), F.lit(".npy")).alias("relpath"))
    return checks.check_paths(v.man, "target_relpath", listing).select("stem", "error")


@query("shape_text", "img", "SELECT stem, in_h || 'x' || in_w AS input_shape, tg_h || 'x' || tg_w AS target_shape FROM img")
def shape_text(v):
    return v.img.select("stem", C.shape_text("in_h", "in_w").alias("input_shape"), C.shape_text("tg_h", "tg_w").alias("target_shape"))


@query("number_text", "met", """SELECT stem, printf('%.10g', psnr_db) AS psnr_db, printf('%.10g', ssim) AS ssim,
  printf('%.10g', lpips_alex) AS lpips_alex FROM met""")
def number_text(v):
    """Ten-digit text of every metric, without trailing zeros."""
    return v.met.select("stem", *[C.number_text(m).alias(m) for m in ("psnr_db", "ssim", "lpips_alex")])


@query("content_sha256", "files", "SELECT side, relpath, sha256(content) AS sha256 FROM files")
def content_sha256(v):
    return v.files.select("side", "relpath", C.content_sha256("content").alias("sha256"))


@query("dataset_digest", "man", """, leaf AS (SELECT stem AS k, sha256(concat_ws(chr(31), stem, input_relpath, target_relpath, trim(split))) AS d,
    substr(sha256(stem), 1, 6) AS b FROM man),
  l6 AS (SELECT b AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM leaf GROUP BY b),
  l3 AS (SELECT substr(k, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY k)) AS d FROM l6 GROUP BY 1)
  SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest FROM l3""")
def dataset_digest(v):
    rows = v.man.withColumn("split", F.trim("split"))
    return digest_rows(rows, "stem", ["stem", "input_relpath", "target_relpath", "split"])


_NUMBERS = [f"{side}_{s}" for side in ("input", "target") for s in ("min", "max", "mean", "std")]


@query("manifest_rendering", "man", "SELECT stem, input_relpath, target_relpath, input_shape, target_shape, input_dtype, target_dtype, "
       + ", ".join(f"printf('%.10g', {n}) AS {n}" for n in _NUMBERS)
       + ", source_group, texture_cluster, split, sha256_input, sha256_target FROM man")
def manifest_rendering(v):
    return render_manifest(v.man)


@query("rank_key", "man", """SELECT stem, sha256('2026:' || stem) AS key, sha256('2026:val_id:' || stem) AS val_key FROM man""")
def rank_key(v):
    return v.man.select("stem", C.rank_key("stem", 2026).alias("key"), C.rank_key("stem", 2026, "val_id").alias("val_key"))


@query("cluster_label", "", "SELECT c_custkey, printf('texture_%02d', c_nationkey) AS label FROM customer")
def cluster_label(v):
    return v.table("customer").select("c_custkey", C.cluster_label("c_nationkey").alias("label"))


@query("learning_rate_schedule", "hist", f"""SELECT step, {r('''CASE WHEN step < 500 THEN (step + 1) / 500.0
  ELSE 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (step - 500) / 4500.0)))) END''')} AS factor FROM hist""")
def learning_rate_schedule(v):
    return v.hist.select("step", C.lr_factor("step", 5000, 500).alias("factor"))


@query("split_filter", "met", "SELECT stem, split FROM met WHERE split IN ('val_id', 'val_ood')")
def split_filter(v):
    return checks.select_splits(v.met, ["val_id", "val_ood"]).select("stem", "split")


@query("train_only", "met", "SELECT stem, ssim_r AS ssim FROM (SELECT stem, " + r("ssim") + " AS ssim_r FROM met WHERE split = 'train')")
def train_only(v):
    return checks.require_train(v.met).select("stem", "ssim")


@query("missing_key_display", "files", f"""SELECT (SELECT string_agg(stem, ', ' ORDER BY stem) FROM (
    SELECT DISTINCT stem FROM files WHERE {_NOISE} ORDER BY stem LIMIT 10)) ||
  CASE WHEN n > 10 THEN ', ... (+' || (n - 10) || ' more)' ELSE '' END AS display
  FROM (SELECT count(DISTINCT stem) AS n FROM files WHERE {_NOISE})""")
def missing_key_display(v):
    return checks.key_sample(v.files.filter(C.is_archive_noise("relpath")), "stem")


@query("count_gate", "man", "SELECT count(*) AS found, count(*) = (SELECT count(*) FROM documents) AS passed FROM man")
def count_gate(v):
    expected = v.table("documents").count()
    rows = checks.require_count(v.man, expected)
    return rows.agg(F.count("*").alias("found")).withColumn("passed", F.col("found") == expected)


@query("scale_pair_predicate", "img", """SELECT stem, tg_h = 2 * (in_h + stem::INT % 2) AND tg_w = 2 * in_w AS is_pair FROM img""")
def scale_pair_predicate(v):
    bent = v.img.withColumn("in_h", F.col("in_h") + F.col("stem").cast("int") % 2)
    return bent.select("stem", C.is_scale_pair().alias("is_pair"))


@query("metric_direction", "grid", """SELECT severity, count(*) FILTER (c.psnr_db > b.psnr_db) AS psnr_db,
  count(*) FILTER (c.ssim > b.ssim) AS ssim, count(*) FILTER (c.lpips_alex < b.lpips_alex) AS lpips_alex
  FROM (SELECT * FROM grid WHERE method = 'candidate') c JOIN (SELECT * FROM grid WHERE method = 'bicubic') b
  USING (relative_path, severity) GROUP BY 1""")
def metric_direction(v):
    pairs = summaries.paired_deltas(v.grid, "bicubic", "candidate")
    return pairs.groupBy("severity").agg(*[F.count(F.when(F.col(f"win_{n}"), 1)).alias(n) for n in ("psnr_db", "ssim", "lpips_alex")])


# --- joins and set operations -----------------------------------------------------


def _sides(v):
    kept = v.files.filter(~C.is_archive_noise("relpath"))
    return kept.filter("side = 'input'"), kept.filter("side = 'target'")


@query("pair_join", "files", f"""SELECT i.stem, i.relpath AS input_relpath, t.relpath AS target_relpath
  FROM (SELECT * FROM files WHERE side = 'input' AND NOT {_NOISE}) i
  JOIN (SELECT * FROM files WHERE side = 'target' AND NOT {_NOISE}) t USING (stem)""")
def pair_join(v):
    inputs, targets = _sides(v)
    return pairing.pair(inputs.select("stem", "relpath"), targets.select("stem", "relpath"), require_full=False)


@query("pairing_gate", "files", f"""SELECT 'target' AS side, stem FROM files i WHERE side = 'input' AND NOT {_NOISE}
    AND stem NOT IN (SELECT stem FROM files WHERE side = 'target' AND NOT {_NOISE})
  UNION ALL SELECT 'input' AS side, stem FROM files WHERE side = 'target' AND NOT {_NOISE}
    AND stem NOT IN (SELECT stem FROM files WHERE side = 'input' AND NOT {_NOISE})""")
def pairing_gate(v):
    return pairing.missing_keys(*_sides(v))


@query("label_join", "met man", """SELECT met.stem, coalesce(nullif(trim(m.split), ''), CASE WHEN m.stem IS NULL THEN 'all_labeled' ELSE 'unassigned' END) AS split,
  coalesce(m.texture_cluster, 'unassigned') AS texture_cluster
  FROM met LEFT JOIN (SELECT '00' || stem AS stem, split, texture_cluster FROM man) m ON met.stem = m.stem""")
def label_join(v):
    labels = label_columns(v.man).withColumn("stem", F.concat(F.lit("00"), "stem"))
    return pairing.attach_labels(v.met.select("stem"), labels).select("stem", "split", "texture_cluster")


@query("unknown_stem_gate", "met man", "SELECT stem FROM met WHERE stem NOT IN (SELECT '00' || stem FROM man)")
def unknown_stem_gate(v):
    known = v.man.select(F.concat(F.lit("00"), "stem").alias("stem"))
    return pairing.unknown_keys(v.met, known)


@query("severity_grid", "", """SELECT p_partkey, severity, method FROM part, (VALUES ('downsample_only'), ('profile_low'), ('profile_high')) s(severity),
  (VALUES ('bicubic'), ('candidate')) m(method)""")
def severity_grid(v):
    names = ("downsample_only", "profile_low", "profile_high")
    return pairing.severity_grid(v.table("part").select("p_partkey"), names, ("bicubic", "candidate"))


@query("output_set_equality", "files", """SELECT 'a' AS side, relpath FROM (SELECT relpath FROM files WHERE side = 'input' EXCEPT SELECT relpath FROM files WHERE side = 'target')
  UNION ALL SELECT 'b' AS side, relpath FROM (SELECT relpath FROM files WHERE side = 'target' EXCEPT SELECT relpath FROM files WHERE side = 'input')""")
def output_set_equality(v):
    return pairing.diff_keys(v.files.filter("side = 'input'"), v.files.filter("side = 'target'"), "relpath")


@query("membership_labels", "man", """SELECT stem, CASE WHEN texture_cluster IN ('texture_02', 'texture_05') THEN 'val_ood' ELSE 'train' END AS split FROM man""")
def membership_labels(v):
    held = v.man.select("texture_cluster").filter(F.col("texture_cluster").isin("texture_02", "texture_05")).distinct()
    return pairing.label_members(v.man.select("stem", "texture_cluster", "split"), held, "texture_cluster", "val_ood", "train").select("stem", "split")


@query("quota_join", "man", """SELECT stem, texture_cluster FROM (SELECT stem, texture_cluster, doc_rank FROM (
    SELECT stem, texture_cluster, stem::BIGINT // 12 + 1 AS doc_rank FROM man)) JOIN
  (SELECT texture_cluster AS c, count(*) // 4 AS quota FROM man GROUP BY 1) ON c = texture_cluster WHERE doc_rank <= quota""")
def quota_join(v):
    ranked = v.man.select("stem", "texture_cluster", (F.floor(F.col("stem").cast("bigint") / 12) + 1).alias("rank"))
    quotas = v.man.groupBy("texture_cluster").agg(F.floor(F.count("*") / 4).alias("quota"))
    return take_quota(ranked, quotas, "texture_cluster").select("stem", "texture_cluster")


@query("method_union", "grid", "SELECT method, count(*) AS rows FROM grid GROUP BY method")
def method_union(v):
    parts = [v.grid.filter(F.col("method") == m) for m in ("bicubic", "candidate")]
    return pairing.union_methods(*parts).groupBy("method").agg(F.count("*").alias("rows"))


# --- audits, key checks and splits ---------------------------------------------------


@query("dataset_audit", "man", f"""SELECT count(*) AS pair_count, {r("min(input_min)")} AS input_min, {r("max(input_max)")} AS input_max,
  {r("max(target_max)")} AS target_max, sum(input_bytes)::BIGINT AS input_bytes, sum(target_bytes)::BIGINT AS target_bytes,
  count(*) FILTER (input_shape = '64x64') AS small_inputs, count(*) FILTER (target_shape = '256x256') AS large_targets FROM man""")
def audit(v):
    row = dataset_audit(v.man)
    return row.select(
        "pair_count", F.col("input.global_min").alias("input_min"), F.col("input.global_max").alias("input_max"),
        F.col("target.global_max").alias("target_max"), F.col("input.file_bytes").alias("input_bytes"),
        F.col("target.file_bytes").alias("target_bytes"),
        F.coalesce(F.col("input.shape_counts")["64x64"], F.lit(0)).alias("small_inputs"),
        F.coalesce(F.col("target.shape_counts")["256x256"], F.lit(0)).alias("large_targets"),
    )


@query("duplicate_keys", "", """SELECT trim(k) AS key, count(*) AS count FROM (SELECT CASE WHEN l_linenumber = 7 THEN '  '
  ELSE l_orderkey || ':' || l_linenumber || ' ' END AS k FROM lineitem) GROUP BY 1 HAVING count(*) > 1 OR trim(k) = ''""")
def duplicate_keys(v):
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit(" "))
    rows = v.table("lineitem").select(F.when(F.col("l_linenumber") == 7, "  ").otherwise(key).alias("key"))
    return checks.duplicate_keys(rows, "key")


@query("split_cluster_counts", "met", "SELECT texture_cluster, split, count(*) AS count FROM met GROUP BY ALL")
def split_cluster_counts(v):
    return pairing.counts(v.met, "texture_cluster", "split")


@query("count_map", "met", "SELECT string_agg(split || '=' || n, ',' ORDER BY split) AS counts FROM (SELECT split, count(*) AS n FROM met GROUP BY 1)")
def count_map(v):
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return pairing.count_map(v.met, "split").select(F.concat_ws(",", pairs).alias("counts"))


@query("hash_holdout", "man", """SELECT stem, CASE WHEN row_number() OVER (ORDER BY sha256('2026:' || stem), stem)
  <= greatest(1, least((SELECT count(*) FROM man) - 1, round_even((SELECT count(*) FROM man) * 0.15::DOUBLE, 0)::BIGINT))
  THEN 'val_id' ELSE 'train' END AS split FROM man""")
def holdout(v):
    return hash_holdout(v.man, 0.15, 2026).select("stem", "split")


@query("hash_holdout_large", "met", """SELECT stem, CASE WHEN row_number() OVER (ORDER BY sha256('7:' || stem), stem)
  <= round_even((SELECT count(*) FROM met) * 0.2::DOUBLE, 0)::BIGINT THEN 'val_id' ELSE 'train' END AS split FROM met""")
def holdout_large(v):
    return hash_holdout(v.met.select("stem"), 0.2, 7)


@query("stratified_holdout", "met", """SELECT stem, texture_cluster, row_number() OVER (PARTITION BY texture_cluster
    ORDER BY sha256('2026:val_id:' || stem), stem) <= quota AS held_out
  FROM met JOIN (SELECT texture_cluster AS c, count(*) * 3 // 20 AS quota FROM met GROUP BY 1) ON c = texture_cluster""")
def stratified(v):
    quotas = v.met.groupBy("texture_cluster").agg(F.floor(F.count("*") * 3 / 20).alias("quota"))
    return stratified_holdout(v.met.select("stem", "texture_cluster"), quotas, "texture_cluster")


@query("output_verification", "img", """SELECT stem AS relpath, CASE WHEN stem::INT % 10 = 3 THEN 'missing output' WHEN stem::INT % 10 = 4 THEN 'dtype is not float32'
  WHEN list_min(target) < 0 OR list_max(target) > 0.98 AND stem::INT % 10 = 5 THEN 'values outside [0,1]'
  WHEN stem::INT % 10 = 6 THEN 'shape is not 2x' END AS violation FROM img
  WHERE stem::INT % 10 IN (3, 4, 6) OR (stem::INT % 10 = 5 AND list_max(target) > 0.98)""")
def output_verification(v):
    n = F.col("stem").cast("int")
    inputs = v.img.select(F.col("stem").alias("relpath"), F.col("in_h").alias("height"), F.col("in_w").alias("width"))
    stretched = F.when(n % 10 == 5, F.transform("target", lambda x: x / 0.98)).otherwise(F.col("target"))
    outputs = v.img.filter(n % 10 != 3).select(
        F.col("stem").alias("relpath"), F.when(n % 10 == 6, 15).otherwise(F.col("tg_h")).alias("height"),
        F.col("tg_w").alias("width"), F.when(n % 10 == 4, "float64").otherwise("float32").alias("src_dtype"),
        F.array_min(stretched).alias("min"), F.array_max(stretched).alias("max"),
        F.lit(None).cast(T.StringType()).alias("error"),
    )
    return output_violations(inputs, outputs)
