"""Queries over a deterministic pixel relation made from `part`, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels, masks, metrics, patterns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The pixel relation: 16 x 16 pixels an image; every third image has a black ring, every fiftieth is black.
PX = """px AS (SELECT img_id, y, x, CASE WHEN bg THEN 0 ELSE r END AS r, CASE WHEN bg THEN 0 ELSE g END AS g, CASE WHEN bg THEN 0 ELSE b END AS b FROM (
  SELECT p_partkey AS img_id, y, x, (p_partkey*31 + x*7 + y*13) % 256 AS r, (p_partkey*17 + x*3 + y*5) % 256 AS g, (p_partkey*7 + x*11 + y) % 256 AS b,
         p_partkey % 50 = 0 OR (p_partkey % 3 = 0 AND (x IN (0, 15) OR y IN (0, 15))) AS bg
  FROM part, range(16) a(y), range(16) c(x)))"""
#: The same in coarse colours, for palettes.
QX = PX + ", qx AS (SELECT img_id, y, x, r - r % 64 AS r, g - g % 64 AS g, b - b % 64 AS b FROM px)"
GRAY = PX + ", gray AS (SELECT img_id, y, x, (r*4899 + g*9617 + b*1868 + 8192) // 16384 AS gray FROM px)"
COL = PX + """, c1 AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM px WHERE r <> 0 OR g <> 0 OR b <> 0), c2 AS (
  SELECT *, (mx - mn)::DOUBLE AS d, (mx + mn)::DOUBLE AS sm FROM c1), c3 AS (SELECT *,
  CASE WHEN mx = mn THEN NULL WHEN b = mx THEN 4.0::DOUBLE + (r - g) / d WHEN g = mx THEN 2.0::DOUBLE + (b - r) / d ELSE (g - b) / d END / 6.0::DOUBLE AS turn,
  CASE WHEN mx = mn THEN NULL WHEN r = mx THEN (g - b) / d WHEN g = mx THEN 2.0::DOUBLE + (b - r) / d ELSE 4.0::DOUBLE + (r - g) / d END * 60.0::DOUBLE AS deg FROM c2), col AS (SELECT img_id, y, x, r, g, b,
  coalesce(CASE WHEN turn < 0 THEN turn + 1 ELSE turn END, 0) AS h, CASE WHEN mx = 0 THEN 0 ELSE d / mx END AS s, mx / 255.0::DOUBLE AS v,
  coalesce(round_even((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2, 0), 0) / 180.0::DOUBLE AS hh, round_even(sm / 2, 0) / 255.0::DOUBLE AS hl,
  round_even(CASE WHEN mx = mn THEN 0 WHEN sm < 255 THEN d * 255 / sm ELSE d * 255 / (510 - sm) END, 0) / 255.0::DOUBLE AS hs FROM c3)"""
_LIN = "CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92::DOUBLE ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4) END"
LIGHT = COL + ", lin AS (SELECT *, " + "(" + _LIN.format(c="r") + ")*0.212671::DOUBLE + (" + _LIN.format(c="g") + ")*0.715160::DOUBLE + (" + _LIN.format(c="b") + ")*0.072169::DOUBLE AS yy FROM col), light AS (SELECT *, 116*(CASE WHEN yy > 0.008856 THEN pow(yy, 1.0::DOUBLE/3) ELSE yy*7.787::DOUBLE + 16.0::DOUBLE/116 END) - 16 AS l FROM lin)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("img_id")
    base = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("img_id"))
    span = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))
    at = base.select("img_id", span.alias("y")).select("img_id", "y", span.alias("x"))
    x, y = F.col("x"), F.col("y")
    black = (p % 50 == 0) | ((p % 3 == 0) & (x.isin(0, 15) | y.isin(0, 15)))
    lit: Callable[[Column], Column] = lambda c: F.when(black, F.lit(0).cast("long")).otherwise(c % 256)
    return at.select("img_id", "y", "x", lit(p * 31 + x * 7 + y * 13).alias("r"), lit(p * 17 + x * 3 + y * 5).alias("g"), lit(p * 7 + x * 11 + y).alias("b"))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("img_id", "y", "x", *[(F.col(c) - F.col(c) % 64).alias(c) for c in "rgb"])


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gray_relation(pixels(spark, sf_dir))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Derived doubles to six places, as engines sum in different orders."""
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = "WITH " + sql
        return f

    return register


MEANS = "round(avg(r), 6) AS mean_red, round(avg(g), 6) AS mean_green, round(avg(b), 6) AS mean_blue, round(avg(h), 6) AS mean_hue, round(avg(s), 6) AS mean_saturation, round(avg(v), 6) AS mean_value, round(avg(l), 6) AS mean_cielab_lightness"


@query("mean_color", LIGHT + f" SELECT img_id, {MEANS} FROM light GROUP BY img_id")
def mean_color(spark, d):
    return rounded(metrics.mean_color(pixels(spark, d)))


@query("skip_empty_left", LIGHT + f", m AS (SELECT img_id, {MEANS} FROM light GROUP BY img_id) SELECT p_partkey AS img_id, m.* EXCLUDE img_id FROM part LEFT JOIN m ON p_partkey = img_id")
def skip_empty_left(spark, d):
    return rounded(metrics.metrics_table(pixels(spark, d)))


def _share(predicate: str) -> str:
    return f"round(avg(({predicate})::INT), 6)"


SPECS = {
    "thresh_single": ([("rgb", 0, 0.6, "above"), ("hls", 1, 0.3, "below")], [("rgb_ch0_above0.6", "r/255.0::DOUBLE >= 0.6"), ("hls_ch1_below0.3", "hl <= 0.3")]),
    "thresh_range_wrap": ([("hls", 0, (340, 20), "between"), ("hls", 2, (0.2, 0.7), "outside")], [("hls_ch0_between340-20", "hh >= 340/360.0::DOUBLE OR hh <= 20/360.0::DOUBLE"), ("hls_ch2_outside0.2-0.7", "NOT (hs >= 0.2 AND hs <= 0.7)")]),
    "thresh_dual": ([("dual", ("hls", 1, 0.3, "above"), ("rgb", 2, 0.5, "below"))], [("dual_hls_ch1_above0.3__AND__rgb_ch2_below0.5", "hl >= 0.3 AND b/255.0::DOUBLE <= 0.5")]),
    "thresh_triple": ([("triple", ("hls", 0, (50, 160), "between"), ("hls", 1, 0.2, "above"), ("hls", 2, 0.3, "above"), "leafy")], [("leafy", "hh >= 50/360.0::DOUBLE AND hh <= 160/360.0::DOUBLE AND hl >= 0.2 AND hs >= 0.3")]),
}
_BRIGHT = {"red": (340, 20), "orange": (20, 50), "yellow": (50, 80), "green": (80, 160), "cyan": (160, 200), "blue": (200, 260), "magenta": (260, 340)}
SPECS["bright_colors"] = (
    metrics.bright_colors(),
    [(f"bright_{n}", f"(hh >= {lo}/360.0::DOUBLE {'OR' if lo > hi else 'AND'} hh <= {hi}/360.0::DOUBLE) AND hl >= {0.15 if n in ('cyan', 'blue') else 0.2} AND hs >= {0.2 if n in ('cyan', 'blue') else 0.3}") for n, (lo, hi) in _BRIGHT.items()]
    + [("hls_ch1_below0.2", "hl <= 0.2")],
)
for _name, (_specs, _sql) in SPECS.items():
    query(_name, COL + ", m AS (SELECT img_id, " + ", ".join(f'{_share(p)} AS "{n}"' for n, p in _sql) + " FROM col GROUP BY img_id) SELECT p_partkey AS img_id, m.* EXCLUDE img_id FROM part LEFT JOIN m ON p_partkey = img_id")(
        lambda spark, d, specs=_specs: rounded(metrics.threshold_fractions(pixels(spark, d), specs))
    )


@query("metrics_records", LIGHT + f""", m AS (SELECT img_id, {MEANS}, {_share("r/255.0::DOUBLE >= 0.6")} AS "rgb_ch0_above0.6" FROM light GROUP BY img_id)
  SELECT m.*, p_brand AS species, p_type AS genus FROM m JOIN part ON p_partkey = img_id""")
def metrics_records(spark, d):
    """The flagship: all metrics of every image in one pass, joined with its record."""
    m = metrics.metrics_table(metrics.foreground(pixels(spark, d)), [("rgb", 0, 0.6, "above")])
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("img_id"), F.col("p_brand").alias("species"), F.col("p_type").alias("genus"))
    return rounded(m.join(part, "img_id"))


@query("palette_global", QX + " SELECT r, g, b, row_number() OVER (ORDER BY r, g, b) AS col FROM (SELECT DISTINCT r, g, b FROM qx WHERE r <> 0 OR g <> 0 OR b <> 0)")
def palette_global(spark, d):
    return metrics.palette(coarse(spark, d))


@query("palette_hsv", QX
       + """, u AS (SELECT DISTINCT r, g, b, greatest(r,g,b) AS mx, least(r,g,b) AS mn FROM qx WHERE r <> 0 OR g <> 0 OR b <> 0), t AS (SELECT *, CASE WHEN mx = mn THEN NULL WHEN b = mx THEN 4.0::DOUBLE + (r-g)/(mx-mn)::DOUBLE WHEN g = mx THEN 2.0::DOUBLE + (b-r)/(mx-mn)::DOUBLE ELSE (g-b)/(mx-mn)::DOUBLE END / 6.0::DOUBLE AS turn FROM u),
  w AS (SELECT r, g, b, coalesce(CASE WHEN turn < 0 THEN turn + 1 ELSE turn END, 0) AS h, (mx-mn)/mx::DOUBLE AS s, mx/255.0::DOUBLE AS v FROM t)
  SELECT format('cluster_{:03d}', row_number() OVER (ORDER BY h, s, v, r, g, b)) AS cluster_id, r, g, b, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM w""")
def palette_hsv(spark, d):
    return rounded(metrics.hsv_palette(coarse(spark, d)))


_SHARES = QX + ", n AS (SELECT img_id, r, g, b, count(*) AS n FROM qx WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY ALL)"


@query("palette_prop_long", _SHARES + " SELECT img_id, r, g, b, round(n / sum(n) OVER (PARTITION BY img_id), 6) AS share FROM n")
def palette_prop_long(spark, d):
    return rounded(metrics.palette_shares(coarse(spark, d)))


@query("palette_prop_wide", QX + " SELECT img_id, round(avg((r=0 AND g=0 AND b=64)::INT), 6) AS col_1_prop, round(avg((r=64 AND g=64 AND b=64)::INT), 6) AS col_2_prop, round(avg((r=192 AND g=128 AND b=0)::INT), 6) AS col_3_prop FROM qx WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY img_id")
def palette_prop_wide(spark, d):
    return rounded(metrics.palette_shares_wide(coarse(spark, d), [(0, 0, 64), (64, 64, 64), (192, 128, 0)]))


_PAL = [("a", 20, 20, 20), ("b", 200, 30, 40), ("c", 40, 180, 60), ("d", 60, 70, 200), ("e", 220, 210, 60), ("f", 128, 128, 128)]


@query("palette_nearest_tol", PX + ", pal(cluster_id, pr, pg, pb) AS (VALUES " + ", ".join(map(str, _PAL)) + """), f AS (SELECT * FROM px WHERE r <> 0 OR g <> 0 OR b <> 0),
  near AS (SELECT img_id, arg_min(cluster_id, (sqrt((r-pr)**2 + (g-pg)**2 + (b-pb)**2), cluster_id)) AS cluster_id, min(sqrt((r-pr)**2 + (g-pg)**2 + (b-pb)**2)) AS dist FROM f, pal GROUP BY img_id, y, x, r, g, b),
  t AS (SELECT img_id, count(*) AS total FROM f GROUP BY img_id)
  SELECT near.img_id, cluster_id, round(count(*) / any_value(total), 6) AS coverage FROM near JOIN t USING (img_id) WHERE dist <= 60 GROUP BY near.img_id, cluster_id""")
def palette_nearest_tol(spark, d):
    pal = spark.createDataFrame(_PAL, "cluster_id string, r long, g long, b long")
    return rounded(metrics.palette_coverage(pixels(spark, d), pal, 60.0))


@query("pattern_summary", QX + ", n AS (SELECT r, g, b, count(*) AS n FROM qx WHERE r+g+b >= 10 GROUP BY ALL) SELECT r, g, b, n, round(n * 100.0 / sum(n) OVER (), 6) AS percent FROM n")
def pattern_summary(spark, d):
    return rounded(metrics.pattern_summary(coarse(spark, d)))


@query("table_counts", QX + " SELECT r, g, b, count(*) AS n FROM qx GROUP BY ALL")
def table_counts(spark, d):
    return metrics.table_counts(coarse(spark, d), "r", "g", "b")


@query("mode_color", QX + ", n AS (SELECT img_id, r, g, b, count(*) AS n, min(y*16+x) AS place FROM qx GROUP BY ALL) SELECT img_id, r, g, b, n FROM n QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY n DESC, place) = 1")
def mode_color(spark, d):
    return metrics.mode_color(coarse(spark, d))


def _clip(side: str, op: str, t: int) -> str:
    some, every = (f" {j} ".join(f"{c} {op} {t}" for c in "rgb") for j in ("OR", "AND"))
    per = ", ".join(f"round(avg(({c} {op} {t})::INT), 6) AS clip_{side}_{c.upper()}_frac" for c in "rgb")
    return f"round(avg(({some})::INT), 6) AS clip_{side}_any_frac, round(avg(({every})::INT), 6) AS clip_{side}_all_frac, round(sum(({every})::INT) / nullif(sum(({some})::INT), 0), 6) AS clip_{side}_sync_ratio, {per}"


@query("clip_metrics", PX + f" SELECT img_id, count(*) AS n_pixels, {_clip('high', '>=', 230)}, {_clip('low', '<=', 26)} FROM px WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY img_id")
def clip_metrics(spark, d):
    return rounded(metrics.clip_metrics(pixels(spark, d), 0.1, 0.9))


@query("midtone", LIGHT + """, p AS (SELECT img_id, count(*) AS n, quantile_cont(l/100, [0.05, 0.95, 0.1, 0.9, 0.5]) AS p FROM light GROUP BY img_id),
  s AS (SELECT light.img_id, greatest(0, least(1, (l/100 - p[1]) / (p[2] - p[1]))) AS s FROM light JOIN p USING (img_id) WHERE n >= 10 AND p[2] > p[1]),
  m AS (SELECT img_id, avg((s BETWEEN 0.25 AND 0.75)::INT) AS ms, avg((s > 0.75)::INT) - avg((s < 0.25)::INT) AS ti FROM s GROUP BY img_id),
  k AS (SELECT p.img_id, n, ms, ti, CASE WHEN ms IS NOT NULL THEN greatest(0, least(1, (p[5]-p[1])/(p[2]-p[1]))) - 0.5 END AS eb, CASE WHEN ms IS NOT NULL AND p[4] > p[3] THEN greatest(0, least(1, (p[5]-p[3])/(p[4]-p[3]))) - 0.5 END AS cb FROM p LEFT JOIN m USING (img_id))
  SELECT img_id, n AS n_nonblack_pixels, round(ms, 6) AS midtone_share, round(eb, 6) AS exposure_bias_median, round(ti, 6) AS tail_imbalance, round((1-ms)*ti, 6) AS directional_midtone_score, round(cb, 6) AS center10_90_bias,
  round((1-ms) * greatest(-1, least(1, CASE WHEN cb IS NULL THEN 0.30*eb + 0.70*ti ELSE 0.85*(0.30*eb + 0.70*ti) + 0.15*cb END)), 6) AS illum_index FROM k""")
def midtone(spark, d):
    return rounded(metrics.midtone(pixels(spark, d)))


@query("colorfulness", PX + """ SELECT img_id, round(sqrt(stddev_pop(abs(r-g))**2 + stddev_pop(abs((r+g)/2.0::DOUBLE-b))**2) + 0.3*sqrt(avg(abs(r-g))**2 + avg(abs((r+g)/2.0::DOUBLE-b))**2), 6) AS colorfulness FROM px GROUP BY img_id""")
def colorfulness(spark, d):
    return rounded(metrics.colorfulness(pixels(spark, d)))


@query("rgb_stats", PX + " SELECT img_id, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in "rgb") + " FROM px GROUP BY img_id")
def rgb_stats(spark, d):
    return rounded(metrics.rgb_stats(pixels(spark, d)))


@query("hist256", PX + ", l AS (SELECT img_id % 25 AS grp, 0 AS channel, r AS v FROM px UNION ALL SELECT img_id % 25, 1, g FROM px UNION ALL SELECT img_id % 25, 2, b FROM px), n AS (SELECT grp, channel, least(255, floor(v * 256 / 255.0::DOUBLE))::INT AS bin, count(*) AS n FROM l GROUP BY ALL) SELECT grp, channel::INT AS channel, bin, n, round(n / sum(n) OVER (PARTITION BY grp, channel), 6) AS share FROM n")
def hist256(spark, d):
    return rounded(metrics.histogram(pixels(spark, d).withColumn("grp", F.col("img_id") % 25), "grp"))


@query("hist3d_l2", PX + ", n AS (SELECT img_id, ((r // 8) * 1024 + (g // 8) * 32 + b // 8)::INT AS bin, count(*) AS n FROM px WHERE r > 0 AND g > 0 AND b > 0 GROUP BY ALL) SELECT img_id, bin, round(n / sqrt(sum(n*n) OVER (PARTITION BY img_id)), 6) AS value FROM n")
def hist3d_l2(spark, d):
    return rounded(metrics.joint_histogram(pixels(spark, d)))


@query("moments_axes", GRAY + """, m AS (SELECT img_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, avg(x*x) - avg(x)*avg(x) + 1/12.0::DOUBLE AS u, avg(y*y) - avg(y)*avg(y) + 1/12.0::DOUBLE AS v, avg(x*y) - avg(x)*avg(y) AS w FROM gray WHERE gray > 1 GROUP BY img_id),
  a AS (SELECT *, sqrt(8*(u+v+sqrt((u-v)**2 + 4*w*w))) AS major, sqrt(greatest(0, 8*(u+v-sqrt((u-v)**2 + 4*w*w)))) AS minor FROM m)
  SELECT img_id, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(major, 6) AS major_axis, round(minor, 6) AS minor_axis, round(major / nullif(minor, 0), 6) AS length_width_ratio, round(sqrt(greatest(0, 1 - minor*minor/(major*major))), 6) AS eccentricity FROM a""")
def moments_axes(spark, d):
    return rounded(metrics.moment_axes(gray(spark, d)))


_M = ", ".join(f"sum(255.0::DOUBLE * x**{p} * y**{q}) AS m{p}{q}" for p in range(4) for q in range(4 - p))


@query("hu_moments", GRAY + f", m AS (SELECT img_id, {_M} FROM gray WHERE gray > 1 GROUP BY img_id), c AS (SELECT *, m10/m00 AS u, m01/m00 AS v FROM m)" + """, n AS (SELECT img_id,
  (m20 - u*m10) / m00**2 AS n20, (m02 - v*m01) / m00**2 AS n02, (m11 - u*m01) / m00**2 AS n11, (m30 - 3*u*m20 + 2*u*u*m10) / m00**2.5 AS n30, (m03 - 3*v*m02 + 2*v*v*m01) / m00**2.5 AS n03,
  (m21 - 2*u*m11 - v*m20 + 2*u*u*m01) / m00**2.5 AS n21, (m12 - 2*v*m11 - u*m02 + 2*v*v*m10) / m00**2.5 AS n12 FROM c)
  SELECT img_id, round(n20 + n02, 6) AS hu1, round((n20-n02)**2 + 4*n11**2, 6) AS hu2, round((n30-3*n12)**2 + (3*n21-n03)**2, 6) AS hu3, round((n30+n12)**2 + (n21+n03)**2, 6) AS hu4 FROM n""")
def hu_moments(spark, d):
    return rounded(metrics.hu_moments(gray(spark, d)))


@query("gray_entropy", GRAY + """, e AS (SELECT img_id, gray, min(gray) OVER (PARTITION BY img_id) AS lo, max(gray) OVER (PARTITION BY img_id) AS hi FROM gray WHERE gray > 0),
  n AS (SELECT img_id, CASE WHEN lo = hi THEN 0 ELSE least(255, floor((gray-lo)*256.0::DOUBLE/(hi-lo))) END AS bin, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT img_id, n / sum(n) OVER (PARTITION BY img_id) AS p FROM n) SELECT img_id, round(-sum(p*ln(p)), 6) AS entropy FROM p GROUP BY img_id""")
def gray_entropy(spark, d):
    return rounded(metrics.gray_entropy(gray(spark, d)))


@query("gray_kurtosis", GRAY + " SELECT img_id, round(CASE WHEN min(gray) < max(gray) THEN kurtosis_pop(gray) END, 6) AS kurtosis FROM gray WHERE gray > 0 GROUP BY img_id")
def gray_kurtosis(spark, d):
    return rounded(metrics.gray_kurtosis(gray(spark, d)))


MASK = GRAY + ", mask AS (SELECT img_id, y, x, CASE WHEN gray > 120 THEN 255 ELSE 0 END AS gray FROM gray)"


def mask(spark, d):
    return masks.mask_of(gray(spark, d), 120)


@query("seg_to_mask", MASK + " SELECT img_id, sum(gray)::BIGINT AS total FROM mask GROUP BY img_id")
def seg_to_mask(spark, d):
    return mask(spark, d).groupBy("img_id").agg(F.sum("gray").alias("total"))


@query("prop_filter", MASK + " SELECT img_id FROM mask GROUP BY img_id HAVING avg((gray > 0)::INT) BETWEEN 0.2 AND 0.6")
def prop_filter(spark, d):
    return masks.mask_facts(mask(spark, d)).where(F.col("share").between(0.2, 0.6)).select("img_id")


@query("border_filter", MASK + " SELECT img_id FROM mask GROUP BY img_id HAVING NOT bool_or(gray = 255 AND (x IN (0, 15) OR y IN (0, 15))) AND max(gray) > 100")
def border_filter(spark, d):
    return masks.filter_reasons(mask(spark, d)).where("reason IS NULL").select("img_id")


_REASON = """, f AS (SELECT img_id, CASE WHEN max(gray) <= 100 THEN 'empty' WHEN NOT avg((gray > 0)::INT) BETWEEN 0.1 AND 0.55 THEN 'prop'
  WHEN NOT (max(CASE WHEN gray > 0 THEN y END) - min(CASE WHEN gray > 0 THEN y END) + 1) / (max(CASE WHEN gray > 0 THEN x END) - min(CASE WHEN gray > 0 THEN x END) + 1) BETWEEN 0.5 AND 1.5 THEN 'hw'
  WHEN bool_or(gray = 255 AND (x IN (0, 15) OR y IN (0, 15))) THEN 'edge' END AS reason FROM mask GROUP BY img_id)"""


@query("filter_reasons", MASK + _REASON + " SELECT img_id, reason FROM f")
def filter_reasons(spark, d):
    return masks.filter_reasons(mask(spark, d), (0.1, 0.55), (0.5, 1.5))


@query("filter_reason_counts", MASK + _REASON + " SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM f GROUP BY ALL")
def filter_reason_counts(spark, d):
    return masks.reason_counts(masks.filter_reasons(mask(spark, d), (0.1, 0.55), (0.5, 1.5)))


@query("valid_images", PX + " SELECT img_id FROM px GROUP BY img_id HAVING max(greatest(r, g, b)) > 0")
def valid_images(spark, d):
    return masks.valid_images(pixels(spark, d))


@query("raw_segment", MASK + " SELECT img_id, sum(CASE WHEN gray <> 0 THEN r ELSE 0 END)::BIGINT AS r, sum(CASE WHEN gray <> 0 THEN g ELSE 0 END)::BIGINT AS g, sum(CASE WHEN gray <> 0 THEN b ELSE 0 END)::BIGINT AS b FROM px JOIN mask USING (img_id, y, x) GROUP BY img_id")
def raw_segment(spark, d):
    return masks.masked(pixels(spark, d), mask(spark, d)).groupBy("img_id").agg(*[F.sum(c).alias(c) for c in "rgb"])


@query("black_alpha", PX + " SELECT img_id, sum((CASE WHEN r+g+b <= 40 THEN 0 ELSE 255 END))::BIGINT AS alpha FROM px GROUP BY img_id")
def black_alpha(spark, d):
    return masks.transparent(pixels(spark, d), 40).groupBy("img_id").agg(F.sum("alpha").alias("alpha"))


@query("invert_mask", MASK + " , w AS (SELECT *, avg((gray > 0)::INT) OVER (PARTITION BY img_id) AS s FROM mask) SELECT img_id, sum(CASE WHEN s > 0.5 THEN 255 - gray ELSE gray END)::BIGINT AS total FROM w GROUP BY img_id")
def invert_mask(spark, d):
    return masks.inverted(mask(spark, d), 0.5).groupBy("img_id").agg(F.sum("gray").alias("total"))


_CHECK = "sum(gray * (y*31 + x*17 + 1))::BIGINT AS checksum, count(*) AS n"


def _checksum(df):
    return df.groupBy("img_id").agg(F.sum(F.col("gray") * (F.col("y") * 31 + F.col("x") * 17 + 1)).cast("long").alias("checksum"), F.count("*").alias("n"))


@query("resize_height", PX + " , t AS (SELECT img_id, y AS ny, x AS nx FROM px WHERE y < 7 AND x < 7), j AS (SELECT t.img_id, ny AS y, nx AS x, px.r AS gray FROM t JOIN px ON px.img_id = t.img_id AND px.y = floor(ny*16/7.0::DOUBLE) AND px.x = floor(nx*16/7.0::DOUBLE)) SELECT img_id, " + _CHECK + " FROM j GROUP BY img_id")
def resize_height(spark, d):
    return _checksum(masks.resized_height(pixels(spark, d), 7).withColumnRenamed("r", "gray"))


@query("pad_to_size", GRAY + " , j AS (SELECT img_id, y + 2 AS y, x + 4 AS x, gray FROM gray) SELECT img_id, sum(gray * (y*31 + x*17 + 1))::BIGINT AS checksum, 480::BIGINT AS n FROM j GROUP BY img_id")
def pad_to_size(spark, d):
    return _checksum(masks.padded(gray(spark, d), 20, 24))


@query("bound_box", MASK + " , b AS (SELECT img_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM mask WHERE gray > 0 GROUP BY img_id), j AS (SELECT mask.img_id, y - y0 AS y, x - x0 AS x, gray FROM mask JOIN b USING (img_id) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1) SELECT img_id, " + _CHECK + " FROM j GROUP BY img_id")
def bound_box(spark, d):
    return _checksum(masks.bounded(mask(spark, d)))


@query("crop_sides", GRAY + " , j AS (SELECT img_id, y, x - 5 AS x, gray FROM gray WHERE x >= 5 AND x < 11) SELECT img_id, " + _CHECK + " FROM j GROUP BY img_id")
def crop_sides(spark, d):
    return _checksum(masks.cropped_sides(gray(spark, d), 3))


@query("flip_heavy", MASK + " , w AS (SELECT img_id, sum((gray > 0 AND y >= 8)::INT) > sum((gray > 0 AND y < 8)::INT) AS f FROM mask GROUP BY img_id), j AS (SELECT img_id, CASE WHEN f THEN 15 - y ELSE y END AS y, x, gray FROM mask JOIN w USING (img_id)) SELECT img_id, " + _CHECK + " FROM j GROUP BY img_id")
def flip_heavy(spark, d):
    return _checksum(masks.heavy_side_up(mask(spark, d)))


@query("equalize", GRAY + """ , n AS (SELECT img_id, gray, count(*) AS n FROM gray GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY gray) AS cdf, sum(n) OVER (PARTITION BY img_id) AS total FROM n), e AS (SELECT *, min(cdf) OVER (PARTITION BY img_id) AS f FROM c),
  j AS (SELECT gray.img_id, y, x, CASE WHEN total = f THEN e.gray ELSE round_even((cdf - f) * 255.0::DOUBLE / (total - f), 0) END::BIGINT AS gray FROM gray JOIN e ON e.img_id = gray.img_id AND e.gray = gray.gray) SELECT img_id, """ + _CHECK + " FROM j GROUP BY img_id")
def equalize(spark, d):
    return _checksum(masks.equalized(gray(spark, d)))


for _n, _low in (("erode", True), ("dilate", False)):
    query(_n, MASK + f" , j AS (SELECT a.img_id, a.y, a.x, {'min' if _low else 'max'}(b.gray) AS gray FROM mask a JOIN mask b ON a.img_id = b.img_id AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY ALL) SELECT img_id, " + _CHECK + " FROM j GROUP BY img_id")(
        lambda spark, d, low=_low: _checksum(masks.neighbour_extreme(mask(spark, d), 3, low))
    )


@query("otsu", GRAY + """ , n AS (SELECT img_id, gray, count(*) AS n FROM gray GROUP BY ALL), c AS (SELECT img_id, gray, sum(n) OVER u AS n0, sum(n*gray) OVER u AS s0, sum(n) OVER w AS n, sum(n*gray) OVER w AS s FROM n WINDOW u AS (PARTITION BY img_id ORDER BY gray), w AS (PARTITION BY img_id)),
  v AS (SELECT img_id, gray, coalesce(n0*(n-n0)*((s0/n0) - (s-s0)/nullif(n-n0, 0))**2, 0) AS v FROM c) SELECT img_id, gray AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY round(v, 3) DESC, gray) = 1""")
def otsu(spark, d):
    return masks.otsu(gray(spark, d))


@query("reconstruct", GRAY + " SELECT img_id, sum(CASE WHEN gray > 150 THEN r ELSE 0 END)::BIGINT AS r, sum(CASE WHEN gray > 150 THEN g ELSE 128 END)::BIGINT AS g, sum(CASE WHEN gray > 150 THEN b ELSE 128 END)::BIGINT AS b FROM px JOIN gray USING (img_id, y, x) GROUP BY img_id")
def reconstruct(spark, d):
    px = pixels(spark, d)
    from ..functions import color

    paint = px.where(color.gray8(F.col("r"), F.col("g"), F.col("b")) > 150)
    return masks.reconstructed(px.select("img_id", "y", "x"), paint, (0, 128, 128)).groupBy("img_id").agg(*[F.sum(c).alias(c) for c in "rgb"])


@query("srt_channel", PX + " , m AS (SELECT img_id, avg(r) AS v FROM px WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY img_id) SELECT p_partkey AS img_id, row_number() OVER (ORDER BY coalesce(v, 0) DESC, p_partkey) AS place FROM part LEFT JOIN m ON p_partkey = img_id")
def srt_channel(spark, d):
    m = metrics.metrics_table(pixels(spark, d)).select("img_id", (-F.coalesce("mean_red", F.lit(0.0))).alias("k"))
    return metrics.numbered(m, ["k", "img_id"], "place").select("img_id", "place")


@query("avg_image_two_level", PX + " , s AS (SELECT p_type AS genus, p_brand AS species, y, x, avg(r) AS r FROM px JOIN part ON p_partkey = img_id GROUP BY ALL) SELECT genus, y, x, floor(round(avg(r), 9))::BIGINT AS r FROM s GROUP BY ALL")
def avg_image_two_level(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("img_id"), F.col("p_brand").alias("species"), F.col("p_type").alias("genus"))
    species = pixels(spark, d).hint("merge").join(part, "img_id").groupBy("genus", "species", "y", "x").agg(F.avg("r").alias("r"))
    return species.groupBy("genus", "y", "x").agg(F.floor(F.round(F.avg("r"), 9)).alias("r"))


@query("metric_extremes", PX + " , m AS (SELECT img_id, avg(r) AS v FROM px WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY img_id), k AS (SELECT img_id, row_number() OVER (ORDER BY v, img_id) AS lo, row_number() OVER (ORDER BY v DESC, img_id) AS hi FROM m) SELECT img_id, 'low' AS side, lo AS place FROM k WHERE lo <= 5 UNION ALL SELECT img_id, 'high', hi FROM k WHERE hi <= 5")
def metric_extremes(spark, d):
    """The five least and greatest: a top-k report."""
    m = metrics.mean_color(pixels(spark, d)).select("img_id", "mean_red")
    low, high = (m.orderBy(o, "img_id").limit(5).withColumn("side", F.lit(s)) for s, o in (("low", F.asc("mean_red")), ("high", F.desc("mean_red"))))
    from pyspark.sql import Window

    place = lambda df, o: df.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(o, "img_id")).cast("long")).select("img_id", "side", "place")
    return place(low, F.asc("mean_red")).unionByName(place(high, F.desc("mean_red")))


@query("mean_dim", PX + " , s AS (SELECT img_id, max(y)+1+img_id%3 AS h, max(x)+1+img_id%5 AS w FROM px GROUP BY img_id) SELECT floor(avg(h))::BIGINT AS mean_h, floor(avg(w))::BIGINT AS mean_w, sum(h+w)::BIGINT AS total FROM s")
def mean_dim(spark, d):
    s = pixels(spark, d).groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).select((F.col("h") + F.col("img_id") % 3).alias("h"), (F.col("w") + F.col("img_id") % 5).alias("w"))
    return s.agg(F.avg("h").cast("long").alias("mean_h"), F.avg("w").cast("long").alias("mean_w"), F.sum(F.col("h") + F.col("w")).alias("total"))


@query("tile_windows", "i AS (SELECT p_partkey AS img_id, 100 + p_partkey % 7 AS h, 400 + p_partkey % 300 AS w FROM part), k AS (SELECT *, least(w, floor(h * 1333/800.0::DOUBLE)::BIGINT) AS win FROM i), t AS (SELECT *, floor((w - win)/3.0::DOUBLE)::BIGINT AS stride FROM k) SELECT img_id, n AS k, n*stride AS x0, least(w, n*stride + win) AS x1 FROM t, range(4) r(n)")
def tile_windows(spark, d):
    p = F.col("p_partkey")
    return masks.tile_windows(spark.read.parquet(f"{d}/part.parquet").select(p.alias("img_id"), (F.lit(100) + p % 7).alias("h"), (F.lit(400) + p % 300).alias("w")), 4)


# Kernels: checked against brute-force versions in the tests.


@query("shape_kernel")
def shape_kernel(spark, d):
    return kernels.facts_of(mask(spark, d), kernels.shape_facts, ["gray"], ["area", "length", "width", "length_width_ratio", "eccentricity", "solidity", "circularity"])


@query("islands_kernel")
def islands_kernel(spark, d):
    return kernels.on_images(mask(spark, d), kernels.largest_part, ["gray"])


@query("blur_kernel")
def blur_kernel(spark, d):
    return kernels.on_images(pixels(spark, d), kernels.gaussian, ["r", "g", "b"])


@query("clahe_kernel")
def clahe_kernel(spark, d):
    return kernels.on_images(gray(spark, d), kernels.clahe, ["gray"])


@query("gabor_kernel")
def gabor_kernel(spark, d):
    return kernels.facts_of(gray(spark, d), kernels.gabor_means, ["gray"], ["gabor_horizontal", "gabor_vertical"])


@query("symmetry_kernel")
def symmetry_kernel(spark, d):
    return kernels.facts_of(mask(spark, d), kernels.symmetry, ["gray"], ["symmetry"])


@query("line_metric_kernel")
def line_metric_kernel(spark, d):
    return kernels.facts_of(gray(spark, d), kernels.line_metrics, ["gray"], ["overlap_sym", "npix_sym", "avg_darkness", "skinniness", "mean_all"])


@query("upright_kernel")
def upright_kernel(spark, d):
    return kernels.on_images(mask(spark, d), kernels.upright, ["gray"])


@query("upright_lines_kernel")
def upright_lines_kernel(spark, d):
    return kernels.on_images(mask(spark, d), lambda a: kernels.upright_by_lines(a, "polygon"), ["gray"])


@query("texture_kernel")
def texture_kernel(spark, d):
    return kernels.facts_of(gray(spark, d), kernels.texture_facts, ["gray"], ["rms_contrast", "edge_density", "grain", "homogeneity", "spectral_slope"])


@query("patch_kernel")
def patch_kernel(spark, d):
    from ..functions import color

    c = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return kernels.patch_table(pixels(spark, d).select("img_id", "y", "x", c.a.alias("l"), c.b.alias("a"), c.c.alias("b")))


@query("part_patch_kernel")
def part_patch_kernel(spark, d):
    """Patches of one shade: parts of equal coarse brightness."""
    return kernels.patch_table(coarse(spark, d), ("r", "g", "b"), how=lambda a: kernels.part_patches(np.where(a.sum(2) > 0, a.sum(2) // 64, -1)))


@query("edge_patch_kernel")
def edge_patch_kernel(spark, d):
    return kernels.patch_table(pixels(spark, d), ("r", "g", "b"), how=lambda a: kernels.edge_patches(a.mean(2)))


@query("longest_run_kernel")
def longest_run_kernel(spark, d):
    return kernels.facts_of(mask(spark, d), kernels.run_facts, ["gray"], ["length", "x0", "y0", "x1", "y1"])


def _brands(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("img_id"), F.col("p_brand").alias("group"))


@query("patterns_individual")
def patterns_individual(spark, d):
    return patterns.patterns(pixels(spark, d), 4, individually=True)


@query("patterns_by_group")
def patterns_by_group(spark, d):
    return patterns.patterns(coarse(spark, d), 5, groups=_brands(spark, d))


@query("patterns_together")
def patterns_together(spark, d):
    return patterns.patterns(coarse(spark, d), 6)


@query("patterns_two_stage")
def patterns_two_stage(spark, d):
    return patterns.two_stage_patterns(pixels(spark, d), 4, 6, groups=_brands(spark, d))
