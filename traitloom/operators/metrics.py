"""Per-image colour metrics over a pixel relation (img_id, y, x, r, g, b).

Each function is one grouped aggregation with map-side partial aggregation: an
image shrinks to a row before the shuffle, so pixels themselves never move.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..storage import unused, written


def rgb() -> tuple[Column, Column, Column]:
    """The channel columns."""
    return F.col("r"), F.col("g"), F.col("b")


def foreground(px: DataFrame) -> DataFrame:
    R, G, B = rgb()
    return px.where(color.is_foreground(R, G, B))


def mean_color_columns(counted: Column | None = None) -> dict[str, Column]:
    """Means over all rows, or over those `counted`."""
    R, G, B = rgb()
    h, s, v = color.hsv(R, G, B)
    light, _, _ = color.lab(R, G, B)
    values = {"red": R, "green": G, "blue": B, "hue": h, "saturation": s, "value": v, "cielab_lightness": light}
    return {f"mean_{k}": F.avg(e if counted is None else F.when(counted, e)) for k, e in values.items()}


def mean_color(px: DataFrame) -> DataFrame:
    """Means over the foreground; images without any give no row.  Hue is averaged arithmetically."""
    return foreground(px).groupBy("img_id").agg(*[v.alias(k) for k, v in mean_color_columns().items()])


def circular_mean_hue(px: DataFrame) -> DataFrame:
    R, G, B = rgb()
    turn = color.hsv(R, G, B).a * (2 * math.pi)
    angle = F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))) / (2 * math.pi)
    return foreground(px).groupBy("img_id").agg(F.when(angle < 0, angle + 1).otherwise(angle).alias("mean_hue_circular"))


def _is_hue(space: str, channel: int) -> bool:
    return space in ("hls", "hsv") and channel == 0


def _as_turn(space: str, channel: int, value: float) -> float:
    """Hue above 1 is in degrees."""
    return value / 360.0 if _is_hue(space, channel) and value > 1 else float(value)


HLS = ("hls_h__", "hls_l__", "hls_s__")


def with_hls(px: DataFrame) -> DataFrame:
    """Pixels with their HLS channels as columns, so that many conditions share one computation."""
    h, light, s = color.hls(*rgb())
    return px.withColumns(dict(zip(HLS, (h, light, s), strict=True)))


def condition(spec: Sequence) -> Column:
    """(space, channel, value, 'below' | 'above') or (space, channel, (low, high), 'between' | 'outside'); all ends count as inside.

    It reads r, g, b, and for hls the columns of with_hls().
    """
    space, channel, limit, direction = str(spec[0]).lower(), int(spec[1]), spec[2], spec[3]
    if space not in ("rgb", "hls") or channel not in (0, 1, 2):
        raise ValueError(f"no such channel: {space}, {channel}")
    value = rgb()[channel] / 255.0 if space == "rgb" else F.col(HLS[channel])
    if isinstance(limit, list | tuple):
        low, high = (_as_turn(space, channel, float(x)) for x in limit)
        over, under = value >= low, value <= high
        inside = over | under if _is_hue(space, channel) and low > high else over & under
        if direction not in ("between", "outside"):
            raise ValueError(f"unknown direction: {direction}")
        return inside if direction == "between" else ~inside
    t = _as_turn(space, channel, float(limit))
    if direction == "below":
        return value <= t
    if direction == "above":
        return value >= t
    raise ValueError(f"unknown direction: {direction}")


def _label(spec: Sequence) -> str:
    limit = f"{spec[2][0]}-{spec[2][1]}" if isinstance(spec[2], list | tuple) else spec[2]
    return f"{spec[0]}_ch{spec[1]}_{spec[3]}{limit}"


def threshold(spec: Sequence) -> tuple[str, Column]:
    """(name, predicate) of a single, range, dual or triple specification; see condition()."""
    kind = str(spec[0]).lower()
    wanted = {"dual": 2, "triple": 3}.get(kind)
    if wanted is None:
        if len(spec) != 4:
            raise ValueError(f"a threshold has four parts: {spec}")
        return _label(spec), condition(spec)
    parts, names = spec[1 : 1 + wanted], spec[1 + wanted :]
    if len(parts) < wanted:
        raise ValueError(f"{kind} needs {wanted} conditions")
    together = condition(parts[0])
    for p in parts[1:]:
        together = together & condition(p)
    return (names[0] if names else f"{kind}_" + "__AND__".join(map(_label, parts))), together


def threshold_fractions(px: DataFrame, specs: Sequence[Sequence]) -> DataFrame:
    """One row for every image; null where an image has no foreground."""
    R, G, B = rgb()
    front = color.is_foreground(R, G, B)
    return with_hls(px).groupBy("img_id").agg(*[F.avg(F.when(front, meets.cast("double"))).alias(name) for name, meets in map(threshold, specs)])


def bright_colors(lightness: float = 0.2, saturation: float = 0.3, blue_lightness: float = 0.15, blue_saturation: float = 0.2) -> list[tuple]:
    """Seven bright hues and melanism."""
    # Hue ranges in degrees.
    ranges = {"red": (340, 20), "orange": (20, 50), "yellow": (50, 80), "green": (80, 160), "cyan": (160, 200), "blue": (200, 260), "magenta": (260, 340)}
    cool = ("cyan", "blue")
    specs: list[tuple] = [
        ("triple", ("hls", 0, hue, "between"), ("hls", 1, blue_lightness if name in cool else lightness, "above"), ("hls", 2, blue_saturation if name in cool else saturation, "above"), f"bright_{name}")
        for name, hue in ranges.items()
    ]
    return [*specs, ("hls", 1, 0.2, "below")]


def metrics_table(px: DataFrame, specs: Sequence[Sequence] = ()) -> DataFrame:
    """All means and thresholds of every image in one pass and one shuffle; images without foreground keep a row of nulls."""
    R, G, B = rgb()
    front = color.is_foreground(R, G, B)
    columns = mean_color_columns(front) | {name: F.avg(F.when(front, meets.cast("double"))) for name, meets in map(threshold, specs)}
    return (with_hls(px) if specs else px).groupBy("img_id").agg(*[v.alias(k) for k, v in columns.items()])


def clip_metrics(px: DataFrame, low: float = 5, high: float = 250, per_channel: bool = True) -> DataFrame:
    """Shares of pixels with any or all channels at an end of the scale; limits up to 1 are shares of 255."""
    R, G, B = rgb()
    low, high = (round(255 * t) if t <= 1 else t for t in (low, high))
    out = [F.count("*").alias("n_pixels")]
    for side, meets in (("high", lambda c: c >= high), ("low", lambda c: c <= low)):
        some, every = meets(R) | meets(G) | meets(B), meets(R) & meets(G) & meets(B)
        n_some, n_every = (F.sum(m.cast("double")) for m in (some, every))
        out += [(n_some / F.count("*")).alias(f"clip_{side}_any_frac"), (n_every / F.count("*")).alias(f"clip_{side}_all_frac"), F.try_divide(n_every, n_some).alias(f"clip_{side}_sync_ratio")]
        if per_channel:
            out += [F.avg(meets(c).cast("double")).alias(f"clip_{side}_{n}_frac") for n, c in (("R", R), ("G", G), ("B", B))]
    return foreground(px).groupBy("img_id").agg(*out)


def midtone(px: DataFrame, robust: tuple[float, float] = (0.05, 0.95), band: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Illumination metrics of lightness stretched between robust percentiles; null where there are under 10 pixels or no spread."""
    R, G, B = rgb()
    light = foreground(px).select("img_id", (color.lab(R, G, B).a / 100.0).alias("l"))
    # values are counted before they are shuffled; all outputs follow from an image's counts
    counts = light.groupBy("img_id", "l").agg(F.count("*").alias("k"))
    shares = F.array(F.lit(robust[0]), F.lit(robust[1]), F.lit(0.1), F.lit(0.9), F.lit(0.5))
    at = counts.groupBy("img_id").agg(F.sum("k").alias("n"), F.percentile("l", shares, F.col("k")).alias("p"), F.collect_list(F.struct("l", "k")).alias("values"))
    fine = (F.col("n") >= 10) & (F.col("p")[1] > F.col("p")[0])
    stretch = lambda v, i, j: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("p")[i]) / (F.col("p")[j] - F.col("p")[i])))
    of = lambda test: F.aggregate("values", F.lit(0).cast("long"), lambda acc, x: acc + F.when(test(stretch(x["l"], 0, 1)), x["k"]).otherwise(0)) / F.col("n")
    tails = of(lambda s: s > band[1]) - of(lambda s: s < band[0])
    out = at.select("img_id", "n", "p", F.when(fine, of(lambda s: s.between(*band))).alias("midtone_share"), F.when(fine, tails).alias("tail_imbalance"))
    # stretching keeps order, so the median can be stretched instead of the values
    median = stretch(F.col("p")[4], 0, 1) - 0.5
    center = F.when(F.col("p")[3] > F.col("p")[2], stretch(F.col("p")[4], 2, 3) - 0.5)
    raw = median * 0.30 + F.col("tail_imbalance") * 0.70
    direction = F.when(center.isNotNull(), raw * 0.85 + center * 0.15).otherwise(raw)
    direction = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), direction))
    known = F.col("midtone_share").isNotNull()
    return out.select(
        "img_id",
        F.col("n").alias("n_nonblack_pixels"),
        "midtone_share",
        F.when(known, median).alias("exposure_bias_median"),
        "tail_imbalance",
        ((F.lit(1.0) - F.col("midtone_share")) * F.col("tail_imbalance")).alias("directional_midtone_score"),
        F.when(known, center).alias("center10_90_bias"),
        F.when(known, (F.lit(1.0) - F.col("midtone_share")) * direction).alias("illum_index"),
    )


def colorfulness(px: DataFrame) -> DataFrame:
    R, G, B = rgb()
    rg, yb = (R - G).cast("double"), ((R + G) / 2.0 - B).cast("double")
    a, c = F.abs(rg), F.abs(yb)
    sq = lambda v: v * v
    value = F.sqrt(sq(F.stddev_pop(a)) + sq(F.stddev_pop(c))) + F.sqrt(sq(F.avg(a)) + sq(F.avg(c))) * 0.3
    return px.groupBy("img_id").agg(value.alias("colorfulness"))


def rgb_stats(px: DataFrame) -> DataFrame:
    """Population mean and deviation of each channel over all pixels."""
    R, G, B = rgb()
    return px.groupBy("img_id").agg(*[f(c).alias(f"{p}_{n}") for n, c in (("r", R), ("g", G), ("b", B)) for p, f in (("mean", F.avg), ("std", F.stddev_pop))])


def histogram(px: DataFrame, group: str = "img_id", bins: int = 256) -> DataFrame:
    """group, channel, bin, share: each channel's histogram over 0..255, closed at its end, summing to 1."""
    R, G, B = rgb()
    long = px.select(group, F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.least(F.lit(bins - 1), F.floor(c * F.lit(bins) / F.lit(255.0))).cast("int").alias("bin")) for i, c in enumerate((R, G, B))])).alias("e"))
    n = long.groupBy(group, "e.channel", "e.bin").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group, "channel")))


def joint_histogram(px: DataFrame, bins: int = 32) -> DataFrame:
    """img_id, bin, value: joint histogram of pixels without any zero channel, of unit Euclidean length."""
    R, G, B = rgb()
    step = 256 // bins
    whole = px.where((R > 0) & (G > 0) & (B > 0))
    cell = sum((F.floor(c / step).cast("int") * m for c, m in ((R, bins * bins), (G, bins), (B, 1))), F.lit(0))
    n = whole.groupBy("img_id", cell.alias("bin")).agg(F.count("*").alias("n"))
    return n.select("img_id", "bin", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("img_id")))).alias("value"))


def pattern_summary(px: DataFrame, least_sum: int = 10) -> DataFrame:
    """Colours of all patterns with counts and percentages of all counted pixels."""
    R, G, B = rgb()
    n = px.where(R + G + B >= least_sum).groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("r", "g", "b", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))  # one row: a scalar


def table_counts(df: DataFrame, *columns: str) -> DataFrame:
    """How often each combination of values occurs."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def mode_color(px: DataFrame) -> DataFrame:
    """The most frequent colour of each image; ties go to the one seen first in reading order."""
    n = px.groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("at"))
    best = n.groupBy("img_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "at", "r", "g", "b")).alias("m"))
    return best.select("img_id", "m.r", "m.g", "m.b", (-F.col("m.k")).alias("n"))


def palette(px: DataFrame) -> DataFrame:
    """Distinct foreground colours of all images, numbered in ascending order."""
    return numbered(foreground(px).select("r", "g", "b").distinct(), ["r", "g", "b"], "col")


def hsv_palette(px: DataFrame) -> DataFrame:
    """cluster_001.. by hue, saturation and value."""
    R, G, B = rgb()
    each = foreground(px).select("r", "g", "b").distinct()
    h, s, v = color.hsv(R, G, B)
    n = numbered(each.select("r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v")), ["h", "s", "v", "r", "g", "b"], "k")
    return n.select(F.format_string("cluster_%03d", F.col("k").cast("long")).alias("cluster_id"), "r", "g", "b", "h", "s", "v")


def ranges_in_order(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """The rows with a `place` that ascends in the given order: the range in its upper bits, from 0 on in the lower 33.

    They are written once: bounds of ranges are sampled, so two plans over the same rows may cut them differently.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn(place, F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1.. in the given order without a single-task window: ranges are sorted apart and offset by the counts before them."""
    place, part, n, before = unused(df, "place__", "part__", "n__", "before__")
    rows = ranges_in_order(df, order, place).withColumn(part, F.shiftright(place, 33))
    counts = rows.groupBy(part).agg(F.count("*").alias(n))  # one row a range
    offsets = counts.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before))
    number = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before) + 1
    return rows.join(F.broadcast(offsets), part).withColumn(name, number.cast("long")).drop(place, part, before)


def palette_shares(px: DataFrame) -> DataFrame:
    """img_id, r, g, b, share: the colours present in each image."""
    n = foreground(px).groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("n"))
    return n.select("img_id", "r", "g", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("img_id"))).alias("share"))


def palette_shares_wide(px: DataFrame, colors: list[tuple[int, int, int]]) -> DataFrame:
    """One share column for each listed colour, 0 where absent."""
    R, G, B = rgb()
    columns = []
    for i, (r, g, b) in enumerate(colors, 1):
        columns.append(F.avg(((R == r) & (G == g) & (B == b)).cast("double")).alias(f"col_{i}_prop"))
    return foreground(px).groupBy("img_id").agg(*columns)


def palette_coverage(px: DataFrame, pal: DataFrame, tolerance: float) -> DataFrame:
    """img_id, cluster_id, coverage: pixels go to the nearest palette colour within `tolerance`; all foreground pixels are the base.

    Only distinct colours (at most 2**24) meet the palette, by cells of side `tolerance`, so no full product is made.
    """
    cell = max(1, math.ceil(tolerance)) if tolerance > 0 else 1
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    each = foreground(px).groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("n"))
    colors = each.select("r", "g", "b").distinct()
    around = F.explode(F.array(*[F.lit(d) for d in ((-1, 0, 1) if tolerance > 0 else (0,))]))
    near = colors.select("r", "g", "b", *[at(c).alias(f"c{c}") for c in "rgb"])
    for c in "rgb":
        near = near.withColumn("d__", around).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d__")).drop("d__")
    marks = pal.select("cluster_id", *[F.col(c).alias(f"p{c}") for c in "rgb"], *[at(c).alias(f"c{c}") for c in "rgb"])
    distance = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")).cast("double") * (F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0.0)))
    hit = near.join(marks, ["cr", "cg", "cb"]).withColumn("d", distance).where(F.col("d") <= tolerance)
    owner = hit.groupBy("r", "g", "b").agg(F.min(F.struct("d", "cluster_id")).alias("m")).select("r", "g", "b", "m.cluster_id")
    total = each.groupBy("img_id").agg(F.sum("n").alias("total"))
    return each.join(owner, ["r", "g", "b"]).groupBy("img_id", "cluster_id").agg(F.sum("n").alias("n")).join(total, "img_id").select("img_id", "cluster_id", (F.col("n") / F.col("total")).alias("coverage"))


def nearest_to_quantiles(df: DataFrame, key: str, metric: str, shares: Sequence[float], k: int) -> DataFrame:
    """quantile, key, value: the k rows nearest to each quantile of a metric; a row goes to the first quantile that takes it.

    Quantiles before take at most k rows each, so of each only the k times their number nearest rows are candidates; ties
    go to the smaller value and key.
    """
    rows = df.where(F.col(metric).isNotNull()).select(F.col(key).alias("id"), F.col(metric).cast("double").alias("value"))
    at = rows.agg(F.percentile("value", F.array(*[F.lit(float(q)) for q in shares])).alias("q")).first().q
    taken, out = set(), []
    for i, target in enumerate(at or ()):
        near = rows.orderBy(F.abs(F.col("value") - F.lit(target)), "value", "id").limit(k * (i + 1)).collect()
        mine = [r for r in near if r.id not in taken][:k]
        taken |= {r.id for r in mine}
        out += [(float(shares[i]), r.id, r.value) for r in mine]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"quantile double, {key} {kind}, value double")


def gray_relation(px: DataFrame) -> DataFrame:
    R, G, B = rgb()
    return px.select("img_id", "y", "x", color.gray8(R, G, B).cast("long").alias("gray"))


def moment_axes(gray: DataFrame, above: int = 1) -> DataFrame:
    """Area, centroid, axes of the ellipse with equal second moments, and eccentricity, of the pixels over a limit."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = gray.where(F.col("gray") > above).groupBy("img_id").agg(F.count("*").alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"))
    u, v, w = F.col("xx") - F.col("cx") * F.col("cx") + 1 / 12, F.col("yy") - F.col("cy") * F.col("cy") + 1 / 12, F.col("xy") - F.col("cx") * F.col("cy")
    root = F.sqrt((u - v) * (u - v) + w * w * 4)
    major, minor = F.sqrt((u + v + root) * 8), F.sqrt(F.greatest(F.lit(0.0), (u + v - root) * 8))
    return m.select("img_id", "area", "cx", "cy", major.alias("major_axis"), minor.alias("minor_axis"), F.try_divide(major, minor).alias("length_width_ratio"), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - (minor * minor) / (major * major))).alias("eccentricity"))


def hu_moments(gray: DataFrame, above: int = 1) -> DataFrame:
    """The first four Hu moments of the 0/255 binary image."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    power = lambda p, q: F.lit(255.0) * (F.lit(1.0) if not p else x if p == 1 else x * x if p == 2 else x * x * x) * (F.lit(1.0) if not q else y if q == 1 else y * y if q == 2 else y * y * y)
    orders = [(p, q) for p in range(4) for q in range(4 - p)]
    m = gray.where(F.col("gray") > above).groupBy("img_id").agg(*[F.sum(power(p, q)).alias(f"m{p}{q}") for p, q in orders])
    c = F.col
    m = m.withColumn("u", c("m10") / c("m00")).withColumn("v", c("m01") / c("m00"))
    u, v = c("u"), c("v")
    mu = {
        "20": c("m20") - u * c("m10"), "02": c("m02") - v * c("m01"), "11": c("m11") - u * c("m01"),
        "30": c("m30") - u * c("m20") * 3 + u * u * c("m10") * 2, "03": c("m03") - v * c("m02") * 3 + v * v * c("m01") * 2,
        "21": c("m21") - u * c("m11") * 2 - v * c("m20") + u * u * c("m01") * 2, "12": c("m12") - v * c("m11") * 2 - u * c("m02") + v * v * c("m10") * 2,
    }
    eta = {k: e / F.pow(c("m00"), F.lit(1 + (int(k[0]) + int(k[1])) / 2)) for k, e in mu.items()}
    n = m.select("img_id", *[e.alias(f"n{k}") for k, e in eta.items()])
    sq = lambda e: e * e
    return n.select(
        "img_id",
        (c("n20") + c("n02")).alias("hu1"),
        (sq(c("n20") - c("n02")) + sq(c("n11")) * 4).alias("hu2"),
        (sq(c("n30") - c("n12") * 3) + sq(c("n21") * 3 - c("n03"))).alias("hu3"),
        (sq(c("n30") + c("n12")) + sq(c("n21") + c("n03"))).alias("hu4"),
    )


def gray_entropy(gray: DataFrame, bins: int = 256) -> DataFrame:
    """Entropy (nats) of the histogram of positive gray values between their least and greatest."""
    w = Window.partitionBy("img_id")
    n = gray.where("gray > 0").groupBy("img_id", "gray").agg(F.count("*").alias("n"))
    n = n.withColumn("lo", F.min("gray").over(w)).withColumn("hi", F.max("gray").over(w)).withColumn("total", F.sum("n").over(w))
    at = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("gray") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))).cast("int")))
    binned = n.groupBy("img_id", "total", at.alias("bin")).agg(F.sum("n").alias("n"))
    p = F.col("n") / F.col("total")
    return binned.groupBy("img_id").agg((-F.sum(p * F.ln(p))).alias("entropy"))


def gray_kurtosis(gray: DataFrame) -> DataFrame:
    """Excess population kurtosis of positive gray values; null where all are equal."""
    k = F.kurtosis("gray")
    return gray.where("gray > 0").groupBy("img_id").agg(F.when(F.min("gray") < F.max("gray"), k).alias("kurtosis"))
