"""Clustering: preparation, fitting, scores, choice of n, assignment and exemplars.

Vectors are array<double> columns named `features`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def long_form(df: DataFrame, *keys: str) -> DataFrame:
    """One row a component: keys, dim, value."""
    return df.select(*keys, F.posexplode("features").alias("dim", "value"))


def wide_form(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"]).alias("features"))


def column_stats(df: DataFrame) -> DataFrame:
    """dim, and the mean, population deviation, least and greatest value: one row a dimension."""
    return long_form(df).groupBy("dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _stat_arrays(df: DataFrame) -> DataFrame:
    """All dimensions' statistics as arrays in one row."""
    one = lambda c: F.transform("s", lambda e: e[c]).alias(c)
    packed = column_stats(df).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "lo", "hi"))).alias("s"))
    return packed.select(one("mean"), one("std"), one("lo"), one("hi"))


def scaled(df: DataFrame, how: str) -> DataFrame:
    """minmax: to [0, 1]; standard: zero mean and unit population deviation.  Constant columns become 0."""
    safe = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    stats = F.broadcast(_stat_arrays(df))  # one row
    if how == "minmax":
        value = F.zip_with(F.zip_with("features", "lo", lambda x, lo: x - lo), F.zip_with("hi", "lo", lambda hi, lo: hi - lo), safe)
    elif how == "standard":
        value = F.zip_with(F.zip_with("features", "mean", lambda x, m: x - m), "std", safe)
    else:
        raise ValueError(f"unknown scaling: {how}")
    return df.join(stats).withColumn("features", value).drop("mean", "std", "lo", "hi")


def weighted(df: DataFrame, weights: list[float]) -> DataFrame:
    return df.withColumn("features", F.zip_with("features", F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w))


def imputed(df: DataFrame) -> DataFrame:
    """Missing or non-finite components take their column's mean over the others."""
    fine = F.transform("features", lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x.cast("double")))
    clean = df.withColumn("features", fine)
    means = clean.select(F.posexplode("features").alias("dim", "value")).groupBy("dim").agg(F.avg("value").alias("mean")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda e: e["mean"]).alias("means__"))
    return clean.join(F.broadcast(means)).withColumn("features", F.zip_with("features", "means__", lambda x, m: F.coalesce(x, m))).drop("means__")


def complete_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def group_means(df: DataFrame, group: str, least: int = 1) -> DataFrame:
    """group, mean vector (`center`) and n of each group with at least `least` rows; components are averaged with map-side sums."""
    each = long_form(df.where(F.col(group).isNotNull()), group).groupBy(group, "dim").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    out = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"]).alias("center"), F.max("n").alias("n"))
    return out.where(F.col("n") >= least)


def exemplars(df: DataFrame, group: str, key: str) -> DataFrame:
    """The row nearest to its group's mean; ties go to the least key."""
    each = df.join(group_means(df, group), group).withColumn("d", squared_distance(F.col("features"), F.col("center")))
    best = each.groupBy(group).agg(F.min(F.struct("d", key)).alias("m"))
    return best.select(group, F.col(f"m.{key}").alias(key), F.sqrt("m.d").alias("distance"))


def nearest_to_mean(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n rows nearest to their group's mean, ranked."""
    each = df.join(group_means(df, group), group).withColumn("d", squared_distance(F.col("features"), F.col("center")))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("d", key)))
    return ranked.where(F.col("rank") <= n).select(group, key, "rank")


def principal_components(df: DataFrame, n: int, key: str) -> DataFrame:
    """Scores on at most n principal components of centred data (signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    means = F.broadcast(_stat_arrays(df).select(F.col("mean").alias("m__")))
    centred = df.join(means).select("*", array_to_vector(F.zip_with("features", "m__", lambda x, m: x - m)).alias("v__"))
    first = centred.select(F.size("features").alias("d")).first()
    k = min(n, first.d if first else n, df.count())
    return PCA(k=max(k, 1), inputCol="v__", outputCol="p__").fit(centred).transform(centred).select(*[c for c in df.columns if c != "features"], vector_to_array("p__").alias("features"))


def fitted(df: DataFrame, algorithm: str = "kmeans", n: int = 3, seed: int = 1, reg: float = 1e-5):
    """(rows with label and probability, model) of kmeans, bisecting_kmeans or gaussian_mixture.

    Ward's linkage and density clustering need all pairs: see kernels.cluster_groups.
    """
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    if algorithm == "gaussian_mixture":
        model = Mixture.fit(df, n, seed, reg)
        return model.transform(df), model
    kinds = {"kmeans": KMeans, "bisecting_kmeans": BisectingKMeans}
    if algorithm not in kinds:
        raise ValueError(f"unknown algorithm: {algorithm}")
    v = df.withColumn("v__", array_to_vector("features"))
    model = kinds[algorithm](k=n, seed=seed, featuresCol="v__", predictionCol="label").fit(v)
    return model.transform(v).drop("v__"), model


class Mixture:
    """A mixture of normal distributions with full covariances, `reg` added to their diagonals.

    Every round of expectation and maximisation is one pass: a task sums its rows'
    weights, weighted values and products, and the driver adds those few numbers up.
    """

    def __init__(self, weights, means, covariances):
        import numpy as np

        self.weights, self.means, self.covariances = (np.asarray(x, float) for x in (weights, means, covariances))
        self.log_likelihood = -math.inf

    def logs(self, x):
        """(rows, parts) log densities times weights."""
        import numpy as np

        out = []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out.append(math.log(max(w, 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi))
        return np.stack(out, axis=1)

    @staticmethod
    def shares(logs):
        """(each row's log density, its probabilities)."""
        import numpy as np

        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        return total, np.exp(logs - total[:, None])

    @classmethod
    def fit(cls, df: DataFrame, n: int, seed: int = 1, reg: float = 1e-5, tol: float = 1e-3, rounds: int = 100) -> Mixture:
        """From k-means groups, until the mean log density gains less than `tol`."""
        import numpy as np
        import pyarrow as pa

        dims = df.select(F.size("features").alias("d")).first().d
        rows = written(fitted(df.select("features"), "kmeans", n, seed)[0].select("features", F.col("label").cast("int").alias("label")))
        model, last = None, -math.inf
        for _ in range(rounds + 1):

            def sums(batches, model=model):
                total, ll = np.zeros((n, 1 + dims + dims * dims)), 0.0
                for b in batches:
                    x = np.array(b.column("features").to_pylist(), float).reshape(b.num_rows, dims)
                    if model is None:
                        p = np.eye(n)[b.column("label").to_numpy()]
                    else:
                        own, p = cls.shares(model.logs(x))
                        ll += float(own.sum())
                    total += np.concatenate((p.sum(0)[:, None], p.T @ x, np.einsum("ij,ik,il->jkl", p, x, x).reshape(n, -1)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([ll])], ["total", "ll"])

            parts = rows.mapInArrow(sums, "total binary, ll double").collect()  # one row a task
            total = sum(np.frombuffer(r.total).reshape(n, -1) for r in parts)
            many = np.maximum(total[:, 0], 1e-300)
            means = total[:, 1 : 1 + dims] / many[:, None]
            products = total[:, 1 + dims :].reshape(n, dims, dims) / many[:, None, None]
            now = sum(r.ll for r in parts)
            if model is not None:
                model.log_likelihood = now
                if (now - last) / many.sum() < tol:
                    return model
                last = now
            model = cls(many / many.sum(), means, products - means[:, :, None] * means[:, None] + reg * np.eye(dims))
        return model

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with label and probability."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

        kept = [c for c in df.columns if c not in ("label", "probability")]
        fields = [*(df.schema[c] for c in kept), StructField("label", IntegerType()), StructField("probability", ArrayType(DoubleType()))]

        def run(batches):
            for b in batches:
                x = np.array(b.column("features").to_pylist(), float).reshape(b.num_rows, self.means.shape[1])
                p = self.shares(self.logs(x))[1]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p.argmax(1).astype(np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))], [*kept, "label", "probability"])

        return df.select(*kept).mapInArrow(run, StructType(fields))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """Between over within dispersion of (features, label)."""
    long = long_form(df, "label")
    g = long.groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    w = Window.partitionBy("dim")
    g = g.withColumn("all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    d = g.withColumn("bs", F.col("n") * (F.col("m") - F.col("all")) * (F.col("m") - F.col("all")))
    t = d.agg(F.sum("bs").alias("b"), F.sum("ss").alias("w"), F.countDistinct("label").alias("k"), F.countDistinct("dim").alias("dims"), F.sum("n").alias("cells"))
    n = F.col("cells") / F.col("dims")
    return t.select(F.try_divide(F.col("b") * (n - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("ch"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance of centres.  Pairs are of clusters, not of rows."""
    m = group_means(df, "label")
    spread = df.join(m, "label").groupBy("label").agg(F.avg(F.sqrt(squared_distance(F.col("features"), F.col("center")))).alias("s"))
    c = m.join(spread, "label").select("label", "center", "s")
    a, b = (c.select(*[F.col(x).alias(x + p) for x in c.columns]) for p in "ab")
    r = a.join(b, F.col("labela") != F.col("labelb")).withColumn("r", F.try_divide(F.col("sa") + F.col("sb"), F.sqrt(squared_distance(F.col("centera"), F.col("centerb")))))
    return r.groupBy("labela").agg(F.max("r").alias("r")).agg(F.avg("r").alias("db"))


def silhouette(df: DataFrame, key: str, block: int = 8192) -> DataFrame:
    """key, label, silhouette (Euclidean, exact) of any number of rows.

    Every row against every row is the definition: each block of rows adds its sums of distances a label.
    """
    import numpy as np

    from .blocks import against_all, distances

    rows = df.select(key, "features", F.col("label").cast("long").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a cluster
    names = np.array(sorted(counts))
    many = np.array([counts[x] for x in names.tolist()])

    def add(states, own, others):
        d = distances(own["features"], others["features"])
        of = np.searchsorted(names, others["label"])
        return np.array(states) + np.stack([np.bincount(of, r, len(names)) for r in d])

    sums = against_all(rows, key, ["features", "label"], "sums__", lambda n: np.zeros((n, len(names))), add, block)
    table = F.array(*[F.struct(F.lit(int(x)).cast("long").alias("label"), F.lit(int(c)).cast("double").alias("n")) for x, c in zip(names, many, strict=True)])
    each = sums.withColumn("s__", F.zip_with("sums__", table, lambda s, t: F.struct(s.alias("s"), t["label"].alias("label"), t["n"].alias("n"))))
    inside = F.element_at(F.filter("s__", lambda e: e["label"] == F.col("label")), 1)
    other = F.array_min(F.transform(F.filter("s__", lambda e: e["label"] != F.col("label")), lambda e: e["s"] / e["n"]))
    each = each.withColumn("a__", inside["s"] / F.greatest(inside["n"] - 1, F.lit(1.0))).withColumn("b__", other).withColumn("n__", inside["n"])
    value = F.when(F.col("n__") == 1, 0.0).otherwise((F.col("b__") - F.col("a__")) / F.greatest("a__", "b__", F.lit(1e-300)))
    return each.select(key, "label", value.alias("silhouette"))


def aic(log_likelihood: float, n: int, dims: int) -> float:
    """Of a full-covariance mixture of n parts."""
    return 2 * (n * dims + n * dims * (dims + 1) / 2 + n - 1) - 2 * log_likelihood


def rank_sums(scores: DataFrame) -> DataFrame:
    """(n, one column a metric): each metric ranked downwards, ties sharing the best rank; ascending by the sum of ranks."""
    metrics = [c for c in scores.columns if c != "n"]
    ranks = scores.select("n", *[F.rank().over(Window.orderBy(F.desc(m))).alias(f"rank_{m}") for m in metrics])  # one row a candidate n
    return ranks.withColumn("total", sum((F.col(f"rank_{m}") for m in metrics), F.lit(0)))


def find_n(df: DataFrame, low: int, high: int, metric: str = "ch", algorithm: str = "kmeans", seed: int = 1) -> int:
    """The number of clusters by ch (most), db or aic (least), or all (least sum of ranks)."""
    if low < 2 and metric != "aic":
        raise ValueError("ch, db and all need at least two clusters")
    rows = []
    for n in range(low, min(high, df.count() - 1) + 1):
        out, model = fitted(df, "gaussian_mixture" if metric == "aic" else algorithm, n, seed)
        if metric == "aic":
            rows.append((n, aic(model.log_likelihood, n, model.means.shape[1])))
        else:
            out = out.persist()
            rows.append((n, calinski_harabasz(out).first().ch, davies_bouldin(out).first().db))
            out.unpersist()
    if metric == "ch":
        return max(rows, key=lambda r: r[1])[0]
    if metric == "db":
        return min(rows, key=lambda r: r[2])[0]
    if metric == "aic":
        return min(rows, key=lambda r: r[1])[0]
    return rank_sums(df.sparkSession.createDataFrame(rows, "n int, ch double, db double")).orderBy("total", "n").first().n


def fuzzy_labels(df: DataFrame, least: float) -> DataFrame:
    """label: the most probable cluster if its probability reaches `least`, else -1."""
    top = F.array_max("probability")
    return df.withColumn("label", F.when(top >= least, F.array_position("probability", top).cast("int") - 1).otherwise(-1))


def outliers_marked(df: DataFrame, percentile: float, group: str | None = None) -> DataFrame:
    """Label -1 where `distance` exceeds the percentile of all (or of the group's) distances."""
    limit = F.percentile("distance", F.lit(percentile / 100.0)).alias("limit__")
    limits = df.groupBy(group).agg(limit) if group else df.agg(limit)
    joined = df.join(limits, group) if group else df.join(F.broadcast(limits))  # one row
    return joined.withColumn("label", F.when(F.col("distance") > F.col("limit__"), F.lit(-1)).otherwise(F.col("label"))).drop("limit__")


def collapsed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values with their counts: what an expensive fit needs to see."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def spread_back(df: DataFrame, labelled: DataFrame, columns: list[str]) -> DataFrame:
    return df.join(labelled.select(*columns, "label"), columns)


def centroid_values(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Each value replaced by its cluster's mean: means are aggregated apart, so a large cluster does not fill a task."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(f"{c}__m") for c in columns])
    return df.join(means, label).select(*[c for c in df.columns if c not in columns], *[F.col(f"{c}__m").alias(c) for c in columns])


def merged_labels(df: DataFrame, groups: str) -> DataFrame:
    """`1,2;3,4`: every label of a group becomes its first."""
    table = {int(x): int(g.split(",")[0]) for g in groups.split(";") if g.strip() for x in g.split(",")}
    if not table:
        return df
    return df.withColumn("label", F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.col("label")], F.col("label")))


def selected(df: DataFrame, choice: str) -> DataFrame:
    """Rows whose label, as text, is in a comma list taken as it is."""
    return df.where(F.col("label").cast("string").isin(choice.split(",")))


def largest_cluster(df: DataFrame, group: str, least: int = 5) -> DataFrame:
    """Rows in the largest cluster of their group (ties: the smaller label); groups with under `least` rows pass whole."""
    n = df.groupBy(group, "label").agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("m"), F.sum("n").alias("all"))
    return df.join(best, group).where((F.col("all") < least) | (F.col("label") == F.col("m.label"))).drop("m", "all")


def morph_labels(df: DataFrame, group: str = "species", least: int = 20) -> DataFrame:
    """species_label of every image of a species with at least `least` images."""
    n = df.groupBy(group).agg(F.count("*").alias("n__")).where(F.col("n__") >= least)
    return df.join(n.select(group), group, "left_semi").withColumn("morph", F.concat_ws("_", F.col(group), F.col("label").cast("string")))


def softmax_choice(images: DataFrame, texts: DataFrame, scale: float = 100.0) -> DataFrame:
    """img_id, text, probability of the text whose embedding is most similar; candidates are (text, features), a short list."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    n = texts.count()
    if n > 10_000:
        raise ValueError(f"{n} candidate texts are too many to broadcast")
    both = images.select("img_id", F.col("features").alias("a")).join(F.broadcast(texts.select("text", F.col("features").alias("b"))))
    logits = both.select("img_id", "text", (dot(F.col("a"), F.col("b")) / (norm(F.col("a")) * norm(F.col("b"))) * scale).alias("z"))
    top = logits.groupBy("img_id").agg(F.max_by("text", F.struct("z", "text")).alias("text"), F.max("z").alias("m"))
    total = logits.join(top.select("img_id", "m"), "img_id").groupBy("img_id").agg(F.sum(F.exp(F.col("z") - F.col("m"))).alias("s"))
    return top.join(total, "img_id").select("img_id", "text", (F.lit(1.0) / F.col("s")).alias("probability"))


def knee(distances: list[float]) -> float:
    """The value at the point farthest from the chord of an ascending curve."""
    n = len(distances)
    if n < 3 or math.isclose(distances[0], distances[-1]):
        return distances[-1] if distances else 0.0
    slope = (distances[-1] - distances[0]) / (n - 1)
    return distances[max(range(n), key=lambda i: abs(distances[0] + slope * i - distances[i]))]


def knee_radius(df: DataFrame, key: str, k: int = 4) -> DataFrame:
    """One row: `eps`, the k-distance at the point of the ascending curve that lies farthest from its chord."""
    from .blocks import k_distances
    from .metrics import numbered

    curve = numbered(k_distances(df, key, k).where("distance IS NOT NULL"), ["distance", key], "i__")
    ends = curve.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n"))
    off = curve.join(F.broadcast(ends)).withColumn("off", F.abs(F.col("lo") + F.try_divide((F.col("hi") - F.col("lo")) * (F.col("i__") - 1), F.col("n") - 1) - F.col("distance")))  # one row of ends
    return off.agg(F.min(F.struct((-F.col("off")).alias("off"), F.col("i__"), F.col("distance"))).alias("m")).select(F.col("m.distance").alias("eps"))
