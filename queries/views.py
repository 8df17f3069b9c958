"""Image, manifest, metric and run views over the driver tables, in Spark and in SQL.

``u(k)`` is a deterministic uniform, equal in both engines: the first eight hex digits of
``md5('2026:' || k)`` divided by 2^32.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from imgtables import configure
from imgtables.functions.columns import hash_uniform, with_path_parts
from imgtables.functions.imaging import make_image
from imgtables.functions.pixels import let

SEVERITY_NAMES = ("downsample_only", "profile_low", "profile_high")


def u(*parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return hash_uniform(F.concat(F.lit("2026:"), *[c.cast("string") for c in columns]))


def sql_u(text: str) -> str:
    return f"(('0x' || substr(md5('2026:' || {text}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """Pin computed columns behind a generator, so later expressions read plain attributes.

    Tables read from storage need no such pin; these pixels are derived by expressions.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def img(self) -> DataFrame:
        """Four consecutive vectors form one 16x16 target, the last filled by repetition; the input is its noisy half size."""
        quads = (
            self.table("embeddings")
            .groupBy(F.floor(F.col("vec_id") / 4).alias("img"))
            .agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("v"))
        )
        vectors = F.flatten(F.transform("v", lambda s: s["embedding"]))
        filled = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda p: F.get(F.col("e"), p % F.size("e")))
        quads = quads.select("img", "v", vectors.alias("e"))
        target = F.transform(
            filled, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + 2.0 * x.cast("double")))
        )

        def noisy_half(target: Column) -> Column:
            def pixel(p: Column) -> Column:
                top = F.floor(p / 8).cast("int") * 32 + (p % 8) * 2
                total = F.get(target, top)
                for step in (1, 16, 17):
                    total = total + F.get(target, top + step)
                return total / 4.0 + 0.9 * (u(F.col("img"), ":", p) - 0.5)

            return F.transform(F.sequence(F.lit(0), F.lit(63)), pixel)

        base = quads.select("img", F.col("v")[0]["label"].alias("source_group"), target.alias("target"))
        return computed_once(base.select(
            F.lpad(F.col("img").cast("string"), 6, "0").alias("stem"),
            "source_group",
            F.lit(8).alias("in_h"), F.lit(8).alias("in_w"), F.lit(16).alias("tg_h"), F.lit(16).alias("tg_w"),
            let(F.col("target"), noisy_half).alias("input"),
            "target",
        ), "input", "target")

    @cached_property
    def pairs(self) -> DataFrame:
        """The same images as struct columns, with a split by image number."""
        number = F.col("stem").cast("int")
        return self.img.select(
            "stem", "source_group",
            F.when(number % 5 == 0, "val_id").when(number % 5 == 1, "val_ood").otherwise("train").alias("split"),
            F.format_string("texture_%02d", number % 4).alias("texture_cluster"),
            make_image("in_h", "in_w", "input").alias("input"),
            make_image("tg_h", "tg_w", "target").alias("target"),
        )

    @cached_property
    def files(self) -> DataFrame:
        n = F.lpad(F.col("doc_id").cast("string"), 6, "0")
        rel = (
            F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("__MACOSX/"), n, F.lit(".npy")))
            .when(F.col("doc_id") % 33 == 0, F.concat(F.lit("a/._"), n, F.lit(".npy")))
            .otherwise(F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), n, F.lit(".npy")))
        )
        both = self.table("documents").select(
            "doc_id", F.explode(F.array(F.lit("input"), F.lit("target"))).alias("side"), rel.alias("path"),
            F.col("text").alias("content"),
        )
        kept = both.filter("side = 'input' or doc_id % 101 != 1")
        return with_path_parts(kept, "path", "/none").select("side", "relpath", "stem", "content", "doc_id")

    @cached_property
    def man(self) -> DataFrame:
        stem = F.lpad(F.col("doc_id").cast("string"), 6, "0")
        size = F.col("n_chars").cast("double")
        return self.table("documents").select(
            stem.alias("stem"),
            F.concat(F.lit("in/"), stem, F.lit(".npy")).alias("input_relpath"),
            F.concat(F.when(F.col("doc_id") % 97 == 3, "../").otherwise("gt/"), stem, F.lit(".npy")).alias("target_relpath"),
            F.when(F.col("n_chars") % 3 == 0, "64x64").otherwise("128x128").alias("input_shape"),
            F.when(F.col("n_chars") % 3 == 0, "128x128").otherwise("256x256").alias("target_shape"),
            F.lit("float32").alias("input_dtype"), F.lit("float32").alias("target_dtype"),
            (-size / 100000).alias("input_min"), (size / 1000).alias("input_max"),
            (size / 2000).alias("input_mean"), (size / 4000).alias("input_std"),
            F.lit(0.0).alias("target_min"), (size / 3000).alias("target_max"),
            (size / 6000).alias("target_mean"), (size / 8000).alias("target_std"),
            F.col("source").alias("source_group"),
            F.format_string("texture_%02d", F.col("doc_id") % 12).alias("texture_cluster"),
            F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 7 == 1, " val_id ").otherwise("train").alias("split"),
            F.sha2(F.col("text").cast("binary"), 256).alias("sha256_input"),
            F.sha2(F.col("source").cast("binary"), 256).alias("sha256_target"),
            F.col("n_chars").alias("input_bytes"), (F.col("n_chars") * 4).alias("target_bytes"),
        )

    @cached_property
    def met(self) -> DataFrame:
        key = F.col("o_orderkey")
        split = F.col("o_orderstatus")
        return self.table("orders").select(
            F.lpad(key.cast("string"), 8, "0").alias("stem"),
            F.when(split == "F", "train").when(split == "O", "val_id").otherwise("val_ood").alias("split"),
            F.format_string("texture_%02d", F.col("o_custkey") % 12).alias("texture_cluster"),
            F.when(key % 97 == 0, F.lit(float("inf"))).when(key % 89 == 0, F.lit(None).cast("double"))
            .otherwise(15.0 + 15.0 * u("psnr:", key)).alias("psnr_db"),
            u("ssim:", key).alias("ssim"),
            F.when(key % 83 != 0, u("lpips:", key)).alias("lpips_alex"),
            u("sobel:", key).alias("sobel_l1"),
            u("bias:", key).alias("mean_intensity_bias"),
            u("oor:", key).alias("pre_clamp_out_of_range_rate"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        names = F.array(*[F.lit(s) for s in SEVERITY_NAMES])
        methods = F.array(F.lit("bicubic"), F.lit("candidate"))
        path = F.concat("p_brand", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
        base = (
            self.table("part").select("p_partkey", "p_brand", path.alias("relative_path"))
            .withColumn("severity", F.explode(names)).withColumn("method", F.explode(methods))
        )
        key = F.concat_ws(":", "relative_path", "severity", "method")
        gone = (F.col("p_partkey") % 83 == 0) & (F.col("method") == "candidate")
        return base.select(
            "relative_path", F.col("p_brand").alias("defect_group"), "severity", "method",
            (15.0 + 15.0 * u(key, ":psnr")).alias("psnr_db"),
            u(key, ":ssim").alias("ssim"),
            F.when(~gone, u(key, ":lpips")).alias("lpips_alex"),
            u(key, ":sobel").alias("sobel_l1"),
            u(key, ":bias").alias("mean_intensity_bias"),
            u(key, ":oor").alias("pre_clamp_out_of_range_rate"),
        )

    @cached_property
    def lat(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("run"), F.col("event_id").alias("iteration"),
            F.col("value").alias("ms"), F.lit(16).alias("batch"),
        )

    @cached_property
    def cand(self) -> DataFrame:
        finite = F.when(~F.isnan("psnr_db") & (F.col("psnr_db") < float("inf")), F.col("psnr_db"))
        return (
            self.met.filter(F.col("split").isin("val_id", "val_ood"))
            .groupBy(F.col("texture_cluster").alias("name"), "split")
            .agg(F.round(F.avg(finite), 1).alias("psnr_db"), F.round(F.avg("ssim"), 2).alias("ssim"),
                 F.round(F.avg("lpips_alex"), 2).alias("lpips_alex"))
            .withColumn("manifest_sha256", F.lit("m1"))
            .withColumn("checkpoint_sha256", F.sha2(F.col("name").cast("binary"), 256))
        )

    @cached_property
    def hist(self) -> DataFrame:
        step = F.col("event_id")
        raw = F.when(step % 25 == 0, 20.0 + 5.0 * u("raw:", step))
        ema = F.when((step % 25 == 0) & (step % 50 != 0), 20.0 + 5.0 * u("ema:", step))
        return self.table("events").select(
            F.col("event_type").alias("run"), step.alias("step"), F.col("value").alias("train_loss"),
            raw.alias("raw_val_psnr_db"), ema.alias("ema_val_psnr_db"),
            F.greatest(raw, ema).alias("selected_val_psnr_db"),
        )

    def tens(self, run: str) -> DataFrame:
        shift = F.when(F.col("vec_id") % 50 == 0, 0.001 * (F.col("vec_id") % 7)).otherwise(F.lit(0.0))
        add = shift if run == "b" else F.lit(0.0)
        return self.table("embeddings").select(
            F.lit(run).alias("run"),
            F.concat(F.lit("t"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("tensor"),
            F.lit("float32").alias("dtype"), F.array(F.lit(8), F.lit(8)).alias("shape"),
            F.transform("embedding", lambda x: x.cast("double") + add).alias("values"),
        )


_PSNR = f"""CASE WHEN o_orderkey % 97 = 0 THEN 'inf'::DOUBLE WHEN o_orderkey % 89 = 0 THEN NULL
  ELSE 15.0::DOUBLE + 15.0::DOUBLE * {sql_u("'psnr:' || o_orderkey")} END"""

SQL = {
    "img": f"""img AS (
  WITH q AS (SELECT vec_id // 4 AS img, flatten(list(embedding ORDER BY vec_id)) AS e,
                    first(label ORDER BY vec_id) AS source_group
             FROM embeddings GROUP BY 1),
       t AS (SELECT img, source_group, list_transform(range(256), lambda p:
               greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 2.0::DOUBLE * e[p % len(e) + 1]::DOUBLE))) AS target FROM q)
  SELECT lpad(img::VARCHAR, 6, '0') AS stem, source_group, 8 AS in_h, 8 AS in_w, 16 AS tg_h, 16 AS tg_w,
         list_transform(range(64), lambda p:
           (target[(p // 8) * 32 + (p % 8) * 2 + 1] + target[(p // 8) * 32 + (p % 8) * 2 + 2]
            + target[(p // 8) * 32 + (p % 8) * 2 + 17] + target[(p // 8) * 32 + (p % 8) * 2 + 18]) / 4.0::DOUBLE
           + 0.9::DOUBLE * ({sql_u("img || ':' || p")} - 0.5::DOUBLE)) AS input,
         target FROM t)""",
    "lab": """lab AS (SELECT stem, CASE WHEN stem::INT % 5 = 0 THEN 'val_id' WHEN stem::INT % 5 = 1 THEN 'val_ood'
  ELSE 'train' END AS split, printf('texture_%02d', stem::INT % 4) AS texture_cluster FROM img)""",
    "tpx": """tpx AS (SELECT stem, (i - 1) // 16 AS y, (i - 1) % 16 AS x, target[i] AS v
  FROM img, LATERAL (SELECT unnest(range(1, 257)) AS i))""",
    "ipx": """ipx AS (SELECT stem, (i - 1) // 8 AS y, (i - 1) % 8 AS x, input[i] AS v
  FROM img, LATERAL (SELECT unnest(range(1, 65)) AS i))""",
    # Antialiased bicubic tap weights: w2 doubles 8 to 16, wh halves 16 to 8.
    "w2": """w2 AS (WITH d AS (SELECT o, i, abs((i + 0.5 - (o + 0.5) * 0.5)::DOUBLE) AS d
    FROM (SELECT unnest(range(16)) AS o), (SELECT unnest(range(8)) AS i)),
  k AS (SELECT o, i, CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1
    WHEN d < 2 THEN (((d - 5) * d + 8) * d - 4) * -0.5 ELSE 0 END::DOUBLE AS w FROM d)
  SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM k)""",
    "wh": """wh AS (WITH d AS (SELECT o, i, abs((i + 0.5 - (o + 0.5) * 2)::DOUBLE) / 2 AS d
    FROM (SELECT unnest(range(8)) AS o), (SELECT unnest(range(16)) AS i)),
  k AS (SELECT o, i, CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1
    WHEN d < 2 THEN (((d - 5) * d + 8) * d - 4) * -0.5 ELSE 0 END::DOUBLE AS w FROM d)
  SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM k)""",
    "up": """up AS (WITH h AS (SELECT stem, y, w2.o AS x, sum(v * w) AS v FROM ipx JOIN w2 ON ipx.x = w2.i GROUP BY 1, 2, 3)
  SELECT stem, w2.o AS y, x, sum(v * w) AS v FROM h JOIN w2 ON h.y = w2.i GROUP BY 1, 2, 3)""",
    "down": """down AS (WITH h AS (SELECT stem, y, wh.o AS x, sum(v * w) AS v FROM tpx JOIN wh ON tpx.x = wh.i GROUP BY 1, 2, 3)
  SELECT stem, wh.o AS y, x, sum(v * w) AS v FROM h JOIN wh ON h.y = wh.i GROUP BY 1, 2, 3)""",
    "files": """files AS (
  WITH n AS (SELECT doc_id, lpad(doc_id::VARCHAR, 6, '0') AS n, text AS content FROM documents),
       p AS (SELECT doc_id, content, CASE WHEN doc_id % 20 = 0 THEN '__MACOSX/' || n || '.npy'
               WHEN doc_id % 33 = 0 THEN 'a/._' || n || '.npy'
               ELSE 'd' || (doc_id % 4) || '/' || n || '.npy' END AS relpath FROM n)
  SELECT side, relpath, regexp_replace(regexp_extract(relpath, '[^/]*$'), '\\.npy$', '') AS stem, content, doc_id
  FROM p, (VALUES ('input'), ('target')) s(side) WHERE side = 'input' OR doc_id % 101 <> 1)""",
    "man": """man AS (
  WITH d AS (SELECT *, lpad(doc_id::VARCHAR, 6, '0') AS stem, n_chars::DOUBLE AS size FROM documents)
  SELECT stem, 'in/' || stem || '.npy' AS input_relpath,
    CASE WHEN doc_id % 97 = 3 THEN '../' ELSE 'gt/' END || stem || '.npy' AS target_relpath,
    CASE WHEN n_chars % 3 = 0 THEN '64x64' ELSE '128x128' END AS input_shape,
    CASE WHEN n_chars % 3 = 0 THEN '128x128' ELSE '256x256' END AS target_shape,
    'float32' AS input_dtype, 'float32' AS target_dtype,
    -size / 100000 AS input_min, size / 1000 AS input_max, size / 2000 AS input_mean, size / 4000 AS input_std,
    0.0::DOUBLE AS target_min, size / 3000 AS target_max, size / 6000 AS target_mean, size / 8000 AS target_std,
    source AS source_group, printf('texture_%02d', doc_id % 12) AS texture_cluster,
    CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 7 = 1 THEN ' val_id ' ELSE 'train' END AS split,
    sha256(text) AS sha256_input, sha256(source) AS sha256_target,
    n_chars AS input_bytes, n_chars * 4 AS target_bytes FROM d)""",
    "met": f"""met AS (SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS stem,
  CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val_id' ELSE 'val_ood' END AS split,
  printf('texture_%02d', o_custkey % 12) AS texture_cluster, {_PSNR} AS psnr_db,
  {sql_u("'ssim:' || o_orderkey")} AS ssim,
  CASE WHEN o_orderkey % 83 <> 0 THEN {sql_u("'lpips:' || o_orderkey")} END AS lpips_alex,
  {sql_u("'sobel:' || o_orderkey")} AS sobel_l1, {sql_u("'bias:' || o_orderkey")} AS mean_intensity_bias,
  {sql_u("'oor:' || o_orderkey")} AS pre_clamp_out_of_range_rate FROM orders)""",
    "metl": """metl AS (UNPIVOT (SELECT stem, split, texture_cluster, coalesce(psnr_db, 'nan'::DOUBLE) AS psnr_db, ssim,
  coalesce(lpips_alex, 'nan'::DOUBLE) AS lpips_alex, sobel_l1, mean_intensity_bias, pre_clamp_out_of_range_rate FROM met)
  ON psnr_db, ssim, lpips_alex, sobel_l1, mean_intensity_bias, pre_clamp_out_of_range_rate INTO NAME metric VALUE value)""",
    "grid": f"""grid AS (
  WITH g AS (SELECT p_partkey, p_brand, p_brand || '/' || lpad(p_partkey::VARCHAR, 6, '0') AS relative_path, severity, method
    FROM part, (VALUES ('downsample_only'), ('profile_low'), ('profile_high')) s(severity),
         (VALUES ('bicubic'), ('candidate')) m(method)),
  k AS (SELECT *, relative_path || ':' || severity || ':' || method AS k FROM g)
  SELECT relative_path, p_brand AS defect_group, severity, method,
    15.0::DOUBLE + 15.0::DOUBLE * {sql_u("k || ':psnr'")} AS psnr_db, {sql_u("k || ':ssim'")} AS ssim,
    CASE WHEN NOT (p_partkey % 83 = 0 AND method = 'candidate') THEN {sql_u("k || ':lpips'")} END AS lpips_alex,
    {sql_u("k || ':sobel'")} AS sobel_l1, {sql_u("k || ':bias'")} AS mean_intensity_bias,
    {sql_u("k || ':oor'")} AS pre_clamp_out_of_range_rate FROM k)""",
    "lat": "lat AS (SELECT event_type AS run, event_id AS iteration, value AS ms, 16 AS batch FROM events)",
    "cand": """cand AS (SELECT texture_cluster AS name, split,
  round(avg(CASE WHEN isfinite(psnr_db) THEN psnr_db END), 1) AS psnr_db, round(avg(ssim), 2) AS ssim,
  round(avg(lpips_alex), 2) AS lpips_alex, 'm1' AS manifest_sha256, sha256(texture_cluster) AS checkpoint_sha256
  FROM met WHERE split IN ('val_id', 'val_ood') GROUP BY 1, 2)""",
    "hist": f"""hist AS (
  WITH h AS (SELECT event_id AS step, value AS train_loss,
    CASE WHEN event_id % 25 = 0 THEN 20.0::DOUBLE + 5.0::DOUBLE * {sql_u("'raw:' || event_id")} END AS raw_val_psnr_db,
    CASE WHEN event_id % 25 = 0 AND event_id % 50 <> 0 THEN 20.0::DOUBLE + 5.0::DOUBLE * {sql_u("'ema:' || event_id")} END AS ema_val_psnr_db
    , event_type AS run FROM events)
  SELECT *, greatest(raw_val_psnr_db, ema_val_psnr_db) AS selected_val_psnr_db FROM h)""",
    "tens": """tens AS (SELECT run, 't' || lpad(vec_id::VARCHAR, 6, '0') AS tensor, vec_id,
  list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN run = 'b' AND vec_id % 50 = 0
    THEN 0.001::DOUBLE * (vec_id % 7) ELSE 0.0::DOUBLE END) AS vals
  FROM embeddings, (VALUES ('a'), ('b')) r(run))""",
}


def sql_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" if names else ""
