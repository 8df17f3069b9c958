"""Image functions and kernels over the ``img`` view, checked pixel by pixel in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtables import materialize
from imgtables.functions import imaging as I
from imgtables.functions import pixels as P
from imgtables.functions import variants
from imgtables.functions.columns import nearest_upsample_index
from imgtables.functions.restoring import Bicubic, predict
from imgtables.schema import SEVERITIES

from .registry import query, r
from .views import computed_once


def _nearest(v):
    """Input enlarged by pixel repetition: a simple prediction both engines can build."""
    index = nearest_upsample_index(8)

    def enlarge(px):
        return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda p: F.get(px, index(p).cast("int")))

    return computed_once(v.img.withColumn("pred", P.let(F.col("input"), enlarge)), "pred")


_NEAR = """, npx AS (SELECT stem, t.y, t.x, i.v AS p, t.v AS t FROM tpx t JOIN ipx i USING (stem) WHERE i.y = t.y // 2 AND i.x = t.x // 2),
  cpx AS (SELECT stem, y, x, p AS raw, least(1, greatest(0, p))::DOUBLE AS p, least(1, greatest(0, t))::DOUBLE AS t FROM npx) """
_PAIR_VIEWS = "img tpx ipx"


@query("psnr_by_group", _PAIR_VIEWS, _NEAR + f""", s AS (SELECT stem, avg(pow(p - t, 2)) AS mse FROM cpx GROUP BY 1)
  SELECT source_group, count(*) AS count, {r("avg(-10 * log10(mse))")} AS psnr_db FROM s JOIN img USING (stem) GROUP BY 1""")
def psnr_by_group(v):
    scored = _nearest(v).select("source_group", P.psnr("pred", "target").alias("p"))
    return scored.groupBy("source_group").agg(F.count("*").alias("count"), F.avg("p").alias("psnr_db"))


@query("psnr_identical", "img", "SELECT stem, 'inf'::DOUBLE AS psnr_db FROM img")
def psnr_identical(v):
    return v.img.select("stem", P.psnr("target", "target").alias("psnr_db"))


_STATS = f"""SELECT stem, {r("list_min(a)")} AS min, {r("list_max(a)")} AS max, {r("list_avg(a)")} AS mean,
  {r("list_stddev_pop(a)")} AS std FROM (SELECT stem, input AS a FROM img)"""


@query("image_stats", "img", _STATS)
def image_stats(v):
    return v.img.select("stem", P.image_stats("input").alias("s")).select("stem", "s.*")


@query("image_stats_kernel", "img", _STATS)
def image_stats_kernel(v):
    return v.pairs.select("stem", I.image_statistics("input").alias("s")).select("stem", "s.*")


@query("pixel_quantiles", "img", f"""SELECT stem, {r("list_aggregate(target, 'quantile_cont', 0.1)")} AS q10,
  {r("list_aggregate(target, 'quantile_cont', 0.9)")} AS q90 FROM img""")
def pixel_quantiles(v):
    return v.img.select("stem", P.quantile("target", 0.1).alias("q10"), P.quantile("target", 0.9).alias("q90"))


@query("clamp_pixels", "img", f"SELECT stem, {r('list_sum(list_transform(input, lambda x: greatest(0, least(1, x))))')} AS total FROM img")
def clamp_pixels(v):
    return v.img.select("stem", F.aggregate(P.clamp01("input"), F.lit(0.0), lambda a, x: a + x).alias("total"))


_GRAD = """, g AS (SELECT stem, y, x, v,
    CASE WHEN y = 0 THEN lead(v) OVER wy - v WHEN y = 15 THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2 END AS gy,
    CASE WHEN x = 0 THEN lead(v) OVER wx - v WHEN x = 15 THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2 END AS gx,
    CASE WHEN y BETWEEN 1 AND 14 AND x BETWEEN 1 AND 14
      THEN abs(lead(v) OVER wy + lag(v) OVER wy + lead(v) OVER wx + lag(v) OVER wx - 4 * v) END AS lap
  FROM tpx WINDOW wy AS (PARTITION BY stem, x ORDER BY y), wx AS (PARTITION BY stem, y ORDER BY x)),
  gs AS (SELECT stem, avg(sqrt(gy * gy + gx * gx)) AS gradient_mean, stddev_pop(sqrt(gy * gy + gx * gx)) AS gradient_std,
    avg(lap) AS laplacian_abs_mean, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.9) AS q90 FROM g GROUP BY 1),
  hb AS (SELECT stem, least(31, floor(v * 32)) AS b, count(*) / 256.0::DOUBLE AS p FROM tpx WHERE v BETWEEN 0 AND 1 GROUP BY 1, 2),
  en AS (SELECT stem, -sum(p * log2(p)) AS entropy_32bin FROM hb GROUP BY 1),
  ct AS (SELECT t.stem, y, x, t.v - gs.mean AS v FROM tpx t JOIN gs USING (stem)),
  f1 AS (SELECT stem, y, k, sum(v * cos(2 * pi() * k * x / 16)) AS re, -sum(v * sin(2 * pi() * k * x / 16)) AS im
    FROM ct, (SELECT unnest(range(9)) AS k) GROUP BY ALL),
  f2 AS (SELECT stem, k, l, pow(sum(re * cos(2 * pi() * l * y / 16) + im * sin(2 * pi() * l * y / 16)), 2)
      + pow(sum(im * cos(2 * pi() * l * y / 16) - re * sin(2 * pi() * l * y / 16)), 2) AS power
    FROM f1, (SELECT unnest(range(16)) AS l) GROUP BY ALL),
  fr AS (SELECT *, sqrt(pow(k / 16.0, 2) + pow(CASE WHEN l < 8 THEN l ELSE l - 16 END / 16.0, 2)) AS radius FROM f2),
  fb AS (SELECT stem, greatest(sum(power), 2.220446049250313e-16) AS total, sum(CASE WHEN radius < 0.12 THEN power ELSE 0 END) AS low,
    sum(CASE WHEN radius >= 0.12 AND radius < 0.30 THEN power ELSE 0 END) AS mid, sum(CASE WHEN radius >= 0.30 THEN power ELSE 0 END) AS high FROM fr GROUP BY 1) """


@query("texture_descriptor", "img tpx", _GRAD + f"""SELECT stem, {", ".join(r(c) + " AS " + c for c in ("mean", "std", "q10", "q90", "entropy_32bin",
  "gradient_mean", "gradient_std", "laplacian_abs_mean"))}, {r("low / total")} AS fft_low_fraction, {r("mid / total")} AS fft_mid_fraction,
  {r("high / total")} AS fft_high_fraction FROM gs JOIN en USING (stem) JOIN fb USING (stem)""")
def texture_descriptor(v):
    return v.pairs.select("stem", I.texture_descriptor("target").alias("d")).select("stem", "d.*")


def _pixels_of(df, image: str):
    return df.select("stem", F.posexplode(f"{image}.pixels").alias("i", "v"))


@query("bicubic_upsample", "img ipx w2 up", f"SELECT stem, (y * 16 + x)::INT AS i, {r('v')} AS v FROM up")
def bicubic_upsample(v):
    return _pixels_of(v.pairs.select("stem", I.resize("input", 2.0, dtype="double").alias("o")), "o")


@query("bicubic_downsample", "img tpx wh down", f"SELECT stem, (y * 8 + x)::INT AS i, {r('v')} AS v FROM down")
def bicubic_downsample(v):
    return _pixels_of(v.pairs.select("stem", I.resize("target", 0.5, dtype="double").alias("o")), "o")


_AREA = f"SELECT stem, ((y // 2) * 8 + x // 2)::INT AS i, {r('avg(v)')} AS v FROM tpx GROUP BY 1, 2"


@query("area_downsample", "img tpx", _AREA)
def area_downsample(v):
    return v.img.select("stem", F.posexplode(P.area_half("target", 16, 16)).alias("i", "v"))


@query("area_downsample_kernel", "img tpx", _AREA)
def area_downsample_kernel(v):
    return _pixels_of(v.pairs.select("stem", I.resize("target", 0.5, "area", dtype="double").alias("o")), "o")


@query("gaussian_blur", "img tpx", f""", k AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-(d * d) / (2 * 0.8 * 0.8)) AS w FROM (SELECT unnest(range(-2, 3)) AS d))),
  hx AS (SELECT a.stem, a.y, a.x, sum(b.v * w) AS v FROM tpx a, k JOIN tpx b ON true WHERE b.stem = a.stem AND b.y = a.y
    AND b.x = CASE WHEN a.x + d < 0 THEN -(a.x + d) WHEN a.x + d > 15 THEN 30 - (a.x + d) ELSE a.x + d END GROUP BY ALL)
  SELECT a.stem, (a.y * 16 + a.x)::INT AS i, {r("sum(b.v * w)")} AS v FROM hx a, k JOIN hx b ON true WHERE b.stem = a.stem AND b.x = a.x
    AND b.y = CASE WHEN a.y + d < 0 THEN -(a.y + d) WHEN a.y + d > 15 THEN 30 - (a.y + d) ELSE a.y + d END GROUP BY ALL""")
def gaussian_blur(v):
    return _pixels_of(v.pairs.select("stem", I.gaussian_blur("target", 0.8, dtype="double").alias("o")), "o")


_D4 = """WITH_ SELECT stem, t, (CASE WHEN t % 4 = 0 THEN y WHEN t % 4 = 1 THEN 7 - x WHEN t % 4 = 2 THEN 7 - y ELSE x END) * 8
    + CASE WHEN t >= 4 THEN 7 - c ELSE c END AS i, v
  FROM (SELECT stem, y, x, v, t, CASE WHEN t % 4 = 0 THEN x WHEN t % 4 = 1 THEN y WHEN t % 4 = 2 THEN 7 - x ELSE 7 - y END AS c
        FROM ipx, (SELECT unnest(range(8)) AS t))""".replace("WITH_ ", "")
_D4_SUM = f"SELECT stem, t::INT AS t, i::INT AS i, {r('v')} AS v FROM ({_D4})"


@query("d4_transform", "img ipx", _D4_SUM)
def d4_transform(v):
    rows = v.img.select("stem", "input", "in_h", "in_w", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    turned = rows.select("stem", "t", P.d4("input", "in_h", "in_w", F.col("t")).alias("o"))
    return turned.select("stem", "t", F.posexplode("o.pixels").alias("i", "v"))


@query("d4_transform_kernel", "img ipx", _D4_SUM)
def d4_transform_kernel(v):
    rows = v.pairs.select("stem", "input", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    turned = rows.select("stem", "t", I.d4("input", F.col("t"), dtype="double").alias("o"))
    return turned.select("stem", "t", F.posexplode("o.pixels").alias("i", "v"))


@query("d4_variants", "img ipx", _D4_SUM)
def d4_variants(v):
    """All eight from one decode, by a table function."""
    turned = variants.d4_variants("double")(v.pairs.select("stem", "input").asTable())
    return turned.select(F.col("key").alias("stem"), "t", F.posexplode("image.pixels").alias("i", "v"))


@query("additive_noise")
def additive_noise(v):
    """Keyed NumPy draws; only the summary of the change is shown."""
    noisy = v.pairs.select("stem", "target", I.add_noise("target", "stem", 0.05, 0.01, dtype="double").alias("o"))
    return noisy.select("stem", P.image_stats("o.pixels").alias("s")).select("stem", "s.*")


@query("speckle_noise")
def speckle_noise(v):
    noisy = v.pairs.select("stem", I.speckle("target", "stem", 0.05, dtype="double").alias("o"))
    return noisy.select("stem", P.image_stats("o.pixels").alias("s")).select("stem", "s.*")


NOISE_TILES = 16  # copies of an image, one below the other, that noise is drawn over


def _drawn_over(pairs, shift: float = 0.0):
    """``stem, target``: each target, raised by ``shift``, ``NOISE_TILES`` times in one image."""
    raised = F.transform("target.pixels", lambda x: x + shift)
    tiled = F.struct(
        (F.col("target.height") * NOISE_TILES).alias("height"), "target.width", F.flatten(F.array_repeat(raised, NOISE_TILES)).alias("pixels")
    )
    return pairs.select("stem", tiled.alias("target"))


def _noise_moments(rows, noise, std: float):
    """Pixels of each image, and whether mean and spread of its noise are those claimed, within eight deviations.

    Besides the right claim a spread half as wide again and a mean one deviation off are put to the test.
    ``rows`` are :func:`_drawn_over`; with so many draws eight deviations are narrower than four of a single
    image were, and no table is large enough for right noise to leave them by chance.
    """
    n = F.size(noise)
    found = rows.select(
        "stem", n.alias("n"), (F.aggregate(noise, F.lit(0.0), lambda s, x: s + x) / n).alias("mean"),
        (F.aggregate(noise, F.lit(0.0), lambda s, x: s + x * x) / n).alias("square"),
    ).withColumn("spread", F.sqrt(F.col("square") - F.col("mean") * F.col("mean")))
    claims = [("right", std, 0.0), ("wider", 1.5 * std, 0.0), ("moved", std, std)]
    tested = F.array(*[
        F.struct(
            F.lit(name).alias("claim"), (F.abs(F.col("mean") - middle) < 8 * width / F.sqrt("n")).alias("centred"),
            (F.abs(F.col("spread") / width - 1) < 8 / F.sqrt(2.0 * F.col("n"))).alias("spread_right"),
        )
        for name, width, middle in claims
    ])
    return found.select("stem", (F.col("n") / NOISE_TILES).cast("int").alias("pixels"), F.inline(tested))


_NOISE_TWIN = """SELECT stem, len(target)::INT AS pixels, claim, claim <> 'moved' AS centred, claim <> 'wider' AS spread_right
  FROM img, (VALUES ('right'), ('wider'), ('moved')) c(claim)"""


@query("additive_noise_moments", "img", _NOISE_TWIN)
def additive_noise_moments(v):
    noisy = _drawn_over(v.pairs).select("stem", "target", I.add_noise("target", "stem", 0.05, 0.01, dtype="double").alias("o"))
    gap = F.zip_with("o.pixels", "target.pixels", lambda a, b: a - b - 0.01)
    return _noise_moments(noisy, gap, 0.05)


@query("speckle_noise_moments", "img", _NOISE_TWIN)
def speckle_noise_moments(v):
    """A black pixel has no speckle; the noise of the others is what their relative change shows."""
    noisy = _drawn_over(v.pairs, 0.5).select("stem", "target", I.speckle("target", "stem", 0.05, dtype="double").alias("o"))
    return _noise_moments(noisy, F.zip_with("o.pixels", "target.pixels", lambda a, b: a / b - 1), 0.05)


_SSIM = """, k AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-(d * d) / (2 * 1.5 * 1.5)) AS w FROM (SELECT unnest(range(-5, 6)) AS d))),
  m AS (SELECT stem, y, x, p, t, p * p AS pp, t * t AS tt, p * t AS pt FROM cpx),
  sx AS (SELECT a.stem, a.y, c.x, sum(p * w) AS p, sum(t * w) AS t, sum(pp * w) AS pp, sum(tt * w) AS tt, sum(pt * w) AS pt
    FROM m a, k, (SELECT unnest(range(5, 11)) AS x) c WHERE a.x = c.x + k.d GROUP BY ALL),
  sy AS (SELECT a.stem, c.y, a.x, sum(p * w) AS p, sum(t * w) AS t, sum(pp * w) AS pp, sum(tt * w) AS tt, sum(pt * w) AS pt
    FROM sx a, k, (SELECT unnest(range(5, 11)) AS y) c WHERE a.y = c.y + k.d GROUP BY ALL),
  ss AS (SELECT stem, avg(((2 * p * t + 0.0001::DOUBLE) * (2 * (pt - p * t) + 0.0009::DOUBLE))
    / ((p * p + t * t + 0.0001::DOUBLE) * (pp - p * p + tt - t * t + 0.0009::DOUBLE))) AS ssim FROM sy GROUP BY 1) """
_PAD = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 15 THEN 30 - ({c}) ELSE {c} END"
_SOBEL = f""", kn AS (SELECT dy, dx, (CASE dy WHEN 0 THEN 2 ELSE 1 END) * dx AS kx, (CASE dx WHEN 0 THEN 2 ELSE 1 END) * dy AS ky
    FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)),
  nb AS (SELECT stem, y, x, kx, ky, {_PAD.format(c="y + dy")} AS sy, {_PAD.format(c="x + dx")} AS sx FROM cpx, kn),
  sg AS (SELECT n.stem, n.y, n.x, sum(c.p * kx) AS px, sum(c.p * ky) AS py, sum(c.t * kx) AS tx, sum(c.t * ky) AS ty
    FROM nb n JOIN cpx c ON c.stem = n.stem AND c.y = n.sy AND c.x = n.sx GROUP BY ALL),
  so AS (SELECT stem, avg(abs(sqrt(px * px + py * py + 1e-12) - sqrt(tx * tx + ty * ty + 1e-12))) AS sobel FROM sg GROUP BY 1) """


@query("ssim", _PAIR_VIEWS, _NEAR + _SSIM + f"SELECT stem, {r('ssim')} AS ssim FROM ss")
def ssim(v):
    rows = _nearest(v).select("stem", I.make_image("tg_h", "tg_w", "pred").alias("p"), I.make_image("tg_h", "tg_w", "target").alias("t"))
    return rows.select("stem", I.ssim("p", "t").alias("ssim"))


@query("sobel_l1", _PAIR_VIEWS, _NEAR + _SOBEL + f"SELECT stem, {r('sobel')} AS sobel_l1 FROM so")
def sobel_l1(v):
    rows = _nearest(v).select("stem", I.make_image("tg_h", "tg_w", "pred").alias("p"), I.make_image("tg_h", "tg_w", "target").alias("t"))
    return rows.select("stem", I.sobel_l1("p", "t").alias("sobel_l1"))


_POINT = f""", pt1 AS (SELECT stem, avg(pow(p - t, 2)) AS mse, abs(avg(p) - avg(t)) AS bias,
  count(*) FILTER (raw < 0 OR raw > 1) / 256.0::DOUBLE AS oor FROM cpx GROUP BY 1) """


@query("mean_bias_and_range", _PAIR_VIEWS, _NEAR + _POINT + f"SELECT stem, {r('bias')} AS bias, {r('oor')} AS rate FROM pt1")
def mean_bias_and_range(v):
    return _nearest(v).select("stem", P.mean_bias("pred", "target").alias("bias"), P.out_of_range_rate("pred").alias("rate"))


@query("image_metrics", _PAIR_VIEWS, _NEAR + _SSIM + _SOBEL + _POINT + f"""SELECT stem, {r("-10 * log10(mse)")} AS psnr_db, {r("ssim")} AS ssim,
  NULL::DOUBLE AS lpips_alex, {r("sobel")} AS sobel_l1, {r("bias")} AS mean_intensity_bias, {r("oor")} AS pre_clamp_out_of_range_rate,
  '16x16' AS prediction_shape, '16x16' AS target_shape FROM ss JOIN so USING (stem) JOIN pt1 USING (stem)""")
def image_metrics(v):
    rows = _nearest(v).select("stem", I.make_image("tg_h", "tg_w", "pred").alias("p"), I.make_image("tg_h", "tg_w", "target").alias("t"))
    return rows.select("stem", I.image_metrics("p", "t").alias("m")).select("stem", "m.*")


@query("perceptual_hook", _PAIR_VIEWS, _NEAR + f"SELECT stem, {r('avg(abs(2 * p - 2 * t))')} AS lpips_alex FROM cpx GROUP BY 1")
def perceptual_hook(v):
    """A stand-in scorer (mean absolute difference of the mapped planes) in the plug-in slot."""

    def scorer(p, t, normalize):
        assert normalize is False and p.shape[1] == 3
        return abs(p.astype("float64") - t).mean(axis=(1, 2, 3))

    rows = _nearest(v).select("stem", I.make_image("tg_h", "tg_w", "pred").alias("p"), I.make_image("tg_h", "tg_w", "target").alias("t"))
    distance = I.perceptual_distance("p", "t", scorer)
    return rows.select("stem", F.round(distance, 6).alias("lpips_alex"))


@query("metric_pair_check", "img", """SELECT stem, CASE WHEN stem::INT % 6 = 1 THEN 'shape mismatch' WHEN stem::INT % 6 = 2 THEN 'non-finite values' END AS error FROM img""")
def metric_pair_check(v):
    n = F.col("stem").cast("int")
    pred = F.when(n % 6 == 2, F.transform("target", lambda x: x / F.lit(0.5) + F.lit(float("inf")))).otherwise(F.col("target"))
    rows = v.img.withColumn("p", pred).withColumn("ph", F.when(n % 6 == 1, 8).otherwise(16))
    return rows.select("stem", P.metric_pair_error("ph", "tg_w", "p", "tg_h", "tg_w", "target").alias("error"))


@query("perceptual_input", "img", f"""SELECT stem, 3 AS channels, {r('list_sum(list_transform(input, lambda x: 2 * greatest(0, least(1, x)) - 1))')} AS total FROM img""")
def perceptual_input(v):
    planes = v.img.select("stem", P.perceptual_input("input").alias("c"))
    total = F.aggregate(F.col("c")[2], F.lit(0.0), lambda a, x: a + x)
    return planes.select("stem", F.size("c").alias("channels"), total.alias("total"))


@query("charbonnier_loss", _PAIR_VIEWS, _NEAR + f"""SELECT stem, {r("avg(sqrt(pow(raw - t, 2) + 1e-6))")} AS supervised,
  {r("0.7 * avg(sqrt(pow(raw - t, 2) + 1e-6)) + 0.3 * avg(sqrt(pow(raw - 0.5, 2) + 1e-6))")} AS blended FROM cpx GROUP BY 1""")
def charbonnier_loss(v):
    teacher = F.transform("target", lambda x: F.lit(0.5))
    rows = _nearest(v).select("stem", P.charbonnier("pred", "target").alias("supervised"), P.charbonnier("pred", teacher).alias("t"))
    return rows.select("stem", "supervised", P.blended_loss("supervised", "t", 0.7, 0.3).alias("blended"))


RESIDUALS = f""", rs AS (SELECT i.stem, i.y, i.x, i.v - d.v AS rs, d.v AS base, i.v AS seen FROM ipx i JOIN down d USING (stem, y, x)),
  ra AS (SELECT stem, rs / base AS q FROM rs WHERE abs(base) > 0.1),
  rm AS (SELECT stem, median(q) AS md FROM ra GROUP BY 1),
  sp AS (SELECT stem, 1.4826 * median(abs(q - md)) AS mad FROM ra JOIN rm USING (stem) GROUP BY 1),
  gr AS (SELECT stem, {"".join(f'''
      CASE WHEN y = 0 THEN lead({c}) OVER wy - {c} WHEN y = 7 THEN {c} - lag({c}) OVER wy ELSE (lead({c}) OVER wy - lag({c}) OVER wy) / 2 END AS gy_{c},
      CASE WHEN x = 0 THEN lead({c}) OVER wx - {c} WHEN x = 7 THEN {c} - lag({c}) OVER wx ELSE (lead({c}) OVER wx - lag({c}) OVER wx) / 2 END AS gx_{c},'''
      for c in ("base", "seen"))} rs FROM rs WINDOW wy AS (PARTITION BY stem, x ORDER BY y), wx AS (PARTITION BY stem, y ORDER BY x)),
  ga AS (SELECT stem, stddev_pop(rs) AS sd, avg(rs) AS mn, avg(sqrt(gy_base * gy_base + gx_base * gx_base)) AS gb,
    avg(sqrt(gy_seen * gy_seen + gx_seen * gx_seen)) AS gs FROM gr GROUP BY 1) """


@query("residual_features", "img tpx ipx wh down", RESIDUALS + f"""SELECT stem, {r("sd")} AS residual_std, {r("mn")} AS residual_mean, {r("mad")} AS speckle_mad,
    {r("least(1.5, greatest(0, (1 - gs / greatest(gb, 1e-8)) * 1.5))")} AS blur_proxy FROM ga JOIN sp USING (stem)""")
def residual_features(v):
    return v.pairs.select("stem", I.residual_features("input", "target").alias("f")).select("stem", "f.*")


@query("prediction_contract", "img", """SELECT stem, kind, kind <> 'half' AS shape_ok, kind <> 'nan' AND (kind <> 'odd' OR stem::INT % 2 = 1) AS finite
  FROM img, (VALUES ('bicubic'), ('half'), ('nan'), ('odd')) k(kind)""")
def prediction_contract(v):
    """Good predictions, ones of the wrong size, with a NaN, and with an infinite value for even images."""
    good = v.pairs.select("stem", "input", predict("input", Bicubic(), "double").alias("o"))

    def first_becomes(value):
        pixels = F.transform("o.pixels", lambda x, i: F.when(i == 0, value).otherwise(x))
        return F.struct("o.height", "o.width", pixels.alias("pixels"))

    odd = F.when(F.col("stem").cast("int") % 2 == 1, F.get("o.pixels", F.lit(0))).otherwise(F.lit(float("inf")))
    kinds = {"bicubic": F.col("o"), "half": F.col("input").cast("struct<height:int,width:int,pixels:array<double>>"),
             "nan": first_becomes(F.lit(float("nan"))), "odd": first_becomes(odd)}
    made = good.select("stem", "input", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), o.cast("struct<height:int,width:int,pixels:array<double>>").alias("p")) for k, o in kinds.items()
    ])))
    shape = (F.col("p.height") == 2 * F.col("input.height")) & (F.col("p.width") == 2 * F.col("input.width"))
    return made.select("stem", "kind", shape.alias("shape_ok"), P.all_finite("p.pixels").alias("finite"))


@query("severity_degradation", "img tpx wh down", f"SELECT stem, (y * 8 + x)::INT AS i, {r('v')} AS v FROM down")
def severity_degradation(v):
    """The no-noise severity equals plain bicubic halving; noisy levels are unit-tested."""
    rows = v.pairs.withColumn("severity", F.lit("downsample_only"))
    low = I.degrade("target", "stem", "severity", SEVERITIES, dtype="double")
    return _pixels_of(rows.select("stem", low.alias("o")), "o")


@query("severity_noise")
def severity_noise(v):
    rows = v.pairs.withColumn("severity", F.explode(F.array(F.lit("profile_low"), F.lit("profile_high"))))
    low = I.degrade("target", "stem", "severity", SEVERITIES, dtype="double")
    noisy = rows.select("stem", "severity", low.alias("o"))
    return noisy.select("stem", "severity", P.image_stats("o.pixels").alias("s")).select("stem", "severity", "s.*")




@query("severity_variants", "img tpx wh down", f"""SELECT stem, 3 AS variants, (y * 8 + x)::INT AS i, {r('v')} AS v FROM down""")
def severity_variants(v):
    """All severities from one decode; the noise-free one is plain bicubic halving."""
    made = variants.severity_variants(dtype="double")(v.pairs.select("stem", "target").asTable()).withColumnRenamed("key", "stem")
    pixels = F.max(F.when(F.col("severity") == "downsample_only", F.col("image.pixels")))
    return made.groupBy("stem").agg(F.count_distinct("severity").cast("int").alias("variants"), pixels.alias("p")).select(
        "stem", "variants", F.posexplode("p").alias("i", "v")
    )


@query("severity_noise_bounds", "img", """SELECT severity, factor, count(*) AS images, factor = 1.0 AS within
  FROM img, (VALUES ('profile_low'), ('profile_high')) s(severity), (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.25::DOUBLE)) f(factor) GROUP BY ALL""")
def severity_noise_bounds(v):
    """The spread of the noise over all pixels is that of its level within a tenth, and not that of a level a quarter off."""
    made = variants.severity_variants(dtype="double")(v.pairs.select("stem", "target").asTable()).withColumnRenamed("key", "stem")
    made = materialize(made.select("stem", "severity", "image.pixels"))
    clean = made.filter("severity = 'downsample_only'").select("stem", F.col("pixels").alias("low"))
    noisy = made.filter("severity <> 'downsample_only'").join(clean, "stem")
    level = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, values in SEVERITIES.items():
        here = F.col("severity") == name
        level = tuple(F.when(here, F.lit(values[k])).otherwise(old) for k, old in zip(("gaussian_noise_std", "speckle_std"), level))
    pixels = noisy.select("stem", "severity", F.inline(F.arrays_zip("pixels", "low")))
    spread = pixels.groupBy("severity").agg(
        F.count_distinct("stem").alias("images"), F.sqrt(F.avg((F.col("pixels") - F.col("low")) ** 2)).alias("found"),
        F.sqrt(F.avg(level[0] ** 2 + (F.col("low") * level[1]) ** 2)).alias("meant"),
    )
    factors = F.explode(F.array(*[F.lit(f) for f in (0.8, 1.0, 1.25)])).alias("factor")
    return spread.select("severity", factors, "images", "found", "meant").select(
        "severity", "factor", "images", (F.col("found") / (F.col("factor") * F.col("meant"))).between(0.9, 1.1).alias("within")
    )
