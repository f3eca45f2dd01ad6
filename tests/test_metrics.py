"""Hand-computed images and properties of the colour metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.functions import color
from traitloom.operators import metrics


def image(spark, rows, img_id="i"):
    """rows: a list of rows of (r, g, b)."""
    data = [(img_id, y, x, *p) for y, row in enumerate(rows) for x, p in enumerate(row)]
    return spark.createDataFrame(data, "img_id string, y int, x int, r int, g int, b int")


def one(df):
    return df.first().asDict()


def test_all_black_gives_no_row_and_null_share(spark):
    px = image(spark, [[(0, 0, 0)] * 2] * 2)
    assert metrics.mean_color(px).count() == 0
    row = one(metrics.threshold_fractions(px, [("rgb", 0, 0.5, "above")]))
    assert row["rgb_ch0_above0.5"] is None
    assert one(metrics.metrics_table(px))["mean_hue"] is None


def test_one_foreground_pixel(spark):
    px = image(spark, [[(0, 0, 0), (0, 0, 0)], [(0, 0, 0), (255, 0, 0)]])
    row = one(metrics.mean_color(px))
    assert (row["mean_red"], row["mean_hue"], row["mean_saturation"], row["mean_value"]) == (255, 0, 1, 1)
    assert row["mean_cielab_lightness"] == pytest.approx(53.24, abs=0.01)


def test_grey_is_flat(spark):
    px = image(spark, [[(128, 128, 128)] * 4] * 4)
    row = one(metrics.midtone(px))
    assert row["n_nonblack_pixels"] == 16 and row["midtone_share"] is None


def test_ends_are_inside(spark):
    px = image(spark, [[(51, 1, 1), (102, 1, 1), (153, 1, 1), (204, 1, 1)]])
    specs = [("rgb", 0, 0.4, "below"), ("rgb", 0, 0.4, "above"), ("rgb", 0, (0.4, 0.6), "between"), ("rgb", 0, (0.4, 0.6), "outside")]
    row = one(metrics.threshold_fractions(px, specs))
    assert [row[metrics.threshold(s)[0]] for s in specs] == [0.5, 0.75, 0.5, 0.5]


def test_hue_wraps_around(spark):
    px = image(spark, [[(255, 0, 43), (255, 43, 0), (0, 255, 255)]])
    row = one(metrics.threshold_fractions(px, [("hls", 0, (340, 20), "between")]))
    assert row["hls_ch0_between340-20"] == pytest.approx(2 / 3)


def test_names_and_errors():
    a, b, c = ("hls", 1, 0.2, "above"), ("rgb", 0, (0.1, 0.9), "between"), ("hls", 2, 0.3, "below")
    assert metrics.threshold(("dual", a, b))[0] == "dual_hls_ch1_above0.2__AND__rgb_ch0_between0.1-0.9"
    assert metrics.threshold(("triple", a, b, c, "mine"))[0] == "mine"
    for bad in [("lab", 0, 1, "above"), ("rgb", 3, 1, "above"), ("rgb", 0, 1, "over"), ("rgb", 0, 1)]:
        with pytest.raises(ValueError):
            metrics.threshold(bad)


def test_dual_is_at_most_its_parts(spark):
    rng = np.random.default_rng(1)
    px = image(spark, [[tuple(map(int, p)) for p in row] for row in rng.integers(0, 256, (6, 6, 3))])
    a, b = ("hls", 1, 0.5, "below"), ("rgb", 2, 0.4, "above")
    row = one(metrics.threshold_fractions(px, [a, b, ("dual", a, b, "both")]))
    assert row["both"] <= min(row["hls_ch1_below0.5"], row["rgb_ch2_above0.4"])


def test_histograms_and_palette_sum_to_one(spark):
    rng = np.random.default_rng(2)
    px = image(spark, [[tuple(map(int, p)) for p in row] for row in rng.integers(1, 256, (5, 7, 3))])
    assert metrics.histogram(px).groupBy("channel").agg(F.sum("share").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert metrics.joint_histogram(px).agg(F.sum(F.col("value") ** 2).alias("s")).first().s == pytest.approx(1)
    assert metrics.palette_shares(px).agg(F.sum("share").alias("s")).first().s == pytest.approx(1)


def test_zero_channel_is_left_out_of_the_joint_histogram(spark):
    assert metrics.joint_histogram(image(spark, [[(0, 10, 10)]])).count() == 0


def test_mode_color_tie_goes_to_the_first(spark):
    row = one(metrics.mode_color(image(spark, [[(9, 9, 9), (1, 1, 1)], [(1, 1, 1), (9, 9, 9)]])))
    assert (row["r"], row["n"]) == (9, 2)


def test_alpha_wraps_only_on_request(spark):
    px = image(spark, [[(128, 128, 0)]])
    alpha = lambda wrap: px.select(color.black_alpha(F.col("r"), F.col("g"), F.col("b"), 0, wrap).alias("a")).first().a
    assert (alpha(False), alpha(True)) == (255, 0)


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = metrics.numbered(df, ["k"], "n").collect()
    assert sorted((r.k, r.n) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_colorfulness_of_grey_is_zero(spark):
    assert one(metrics.colorfulness(image(spark, [[(7, 7, 7)] * 3])))["colorfulness"] == 0


def test_moments_of_a_bar(spark):
    gray = metrics.gray_relation(image(spark, [[(200, 200, 200)] * 9]))
    row = one(metrics.moment_axes(gray))
    assert row["area"] == 9 and row["major_axis"] == pytest.approx(4 * math.sqrt(9 * 9 / 12)) and row["minor_axis"] == pytest.approx(4 * math.sqrt(1 / 12))
