"""Segments to patterns: colours are clustered by image, by group or over all, and every pixel takes its cluster's mean.

Only distinct colours are clustered, weighted by their pixels.  The 2**24 colours
bound what one group's task holds; over all images a distributed fit is used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import foreground

RGB = ("r", "g", "b")


def weighted_kmeans(x: np.ndarray, weight: np.ndarray, n: int, rounds: int = 100) -> np.ndarray:
    """Labels of rows by Lloyd's rounds from the heaviest row and the rows farthest from all before."""
    first = int(np.lexsort((*x.T[::-1], -weight))[0])
    centers, near = [x[first]], ((x - x[first]) ** 2).sum(1)
    while len(centers) < min(n, len(x)) and near.max() > 0:
        centers.append(x[int(near.argmax())])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    c, label = np.array(centers, float), np.full(len(x), -1)
    for _ in range(rounds):
        d = np.stack([((x - m) ** 2).sum(1) for m in c], axis=1)
        new = d.argmin(1)
        if np.array_equal(new, label):
            break
        label = new
        total = np.bincount(label, weight, len(c))
        for k in range(x.shape[1]):
            c[:, k] = np.where(total > 0, np.bincount(label, weight * x[:, k], len(c)) / np.maximum(total, 1e-300), c[:, k])
    return label


def color_labels(colors: DataFrame, scope: list[str], n: int, seed: int = 1) -> DataFrame:
    """scope, r, g, b, n, label of distinct colours (scope, r, g, b, n pixels), clustered within each scope."""
    if not scope:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        v = colors.withColumn("v__", array_to_vector(F.array(*[F.col(c).cast("double") for c in RGB])))
        return KMeans(k=n, seed=seed, featuresCol="v__", predictionCol="label", weightCol="n").fit(v).transform(v).select(*RGB, "n", "label")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(RGB)).reset_index(drop=True)
        return pdf.assign(label=weighted_kmeans(pdf[list(RGB)].to_numpy(float), pdf["n"].to_numpy(float), n))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in colors.schema)
    return colors.groupBy(*scope).applyInPandas(run, f"{fields}, label int")


def recolored(px: DataFrame, labels: DataFrame, scope: list[str]) -> DataFrame:
    """Foreground pixels take the mean colour of their cluster, rounded; the background stays."""
    by, w = [*scope, "label"], Window.partitionBy(*scope, "label")
    mean = lambda c, of: F.round(of(F.sum(F.col(c) * F.col("n"))) / of(F.sum("n"))).cast("long").alias(f"m{c}")
    if scope:
        table = labels.select(*scope, *RGB, *[mean(c, lambda total: total.over(w)) for c in RGB])
    else:
        table = labels.join(F.broadcast(labels.groupBy(*by).agg(*[mean(c, lambda total: total) for c in RGB])), by).select(*RGB, "mr", "mg", "mb")
    # Spark does not know how many colours there are, and would take them for few
    return px.join(table.hint("merge"), [*scope, *RGB], "left").select("img_id", "y", "x", *[F.coalesce(f"m{c}", F.col(c).cast("long")).alias(c) for c in RGB])


def patterns(px: DataFrame, n: int, *, groups: DataFrame | None = None, individually: bool = False, unique: bool = False, seed: int = 1) -> DataFrame:
    """Pixels of the patterns of segments (img_id, y, x, r, g, b).

    groups: (img_id, group), clustered group by group; images without a group form one.  individually: each image apart.
    Otherwise all together.  unique: each colour counts once in a group, whatever its pixels.
    """
    scope: list[str] = ["img_id"] if individually else ["group"] if groups is not None else []
    rows = px.join(groups.select("img_id", F.coalesce(F.col("group").cast("string"), F.lit("")).alias("group")), "img_id", "left").fillna("", ["group"]) if scope == ["group"] else px
    colors = foreground(rows).groupBy(*scope, *RGB).agg(F.count("*").alias("n"))
    if unique:
        colors = colors.withColumn("n", F.lit(1).cast("long"))
    return recolored(rows, color_labels(colors, scope, n, seed), scope)


def two_stage_patterns(px: DataFrame, n_image: int, n: int, groups: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """Images are clustered apart, then the colours of their patterns together (by group where given), each colour once."""
    return patterns(patterns(px, n_image, individually=True), n, groups=groups, unique=True, seed=seed)
