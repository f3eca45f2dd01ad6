"""Clustering queries over `embeddings`, each with its SQL where labels don't come from a fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, cluster, kernels
from .pixel_queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = "WITH " + sql
        return f

    return register


def vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), l AS (SELECT vec_id, label, unnest(f) AS v, generate_subscripts(f, 1) AS dim FROM e)"
DIST = "sqrt(sum((l.v - m.v)**2))"
MEAN = E + ", m AS (SELECT label, dim, avg(v) AS v, count(*) AS n FROM l GROUP BY 1, 2), d AS (SELECT l.vec_id, l.label, " + DIST + " AS dist FROM l JOIN m ON l.label = m.label AND l.dim = m.dim GROUP BY 1, 2)"


def long(df, *keys):
    return df.select(*keys, F.posexplode("features").alias("dim", "value")).select(*keys, (F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("scale_minmax", E + ", s AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1) SELECT vec_id, l.dim, round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 6) AS value FROM l JOIN s ON l.dim = s.dim")
def scale_minmax(spark, d):
    return long(cluster.scaled(vectors(spark, d), "minmax"), "vec_id")


@query("scale_standard", E + ", s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY 1) SELECT vec_id, l.dim, round(coalesce((v - m) / nullif(sd, 0), 0), 6) AS value FROM l JOIN s ON l.dim = s.dim")
def scale_standard(spark, d):
    return long(cluster.scaled(vectors(spark, d), "standard"), "vec_id")


@query("feature_weights", E + " SELECT vec_id, dim, round(v * (dim % 4 + 1) / 2.0::DOUBLE, 6) AS value FROM l")
def feature_weights(spark, d):
    return long(cluster.weighted(vectors(spark, d), [(i % 4 + 1) / 2 for i in range(1, 65)]), "vec_id")


_HOLES = E + ", h AS (SELECT vec_id, dim, CASE WHEN (vec_id + dim) % 117 = 0 THEN NULL ELSE v END AS v FROM l)"


def _holes(spark, d):
    v = vectors(spark, d)
    return v.withColumn("features", F.transform("features", lambda x, i: F.when((F.col("vec_id") + i + 1) % 117 == 0, None).otherwise(x)))


@query("impute_mean", _HOLES + " SELECT vec_id, dim, round(coalesce(v, avg(v) OVER (PARTITION BY dim)), 6) AS value FROM h")
def impute_mean(spark, d):
    return long(cluster.imputed(_holes(spark, d)), "vec_id")


@query("drop_nan_rows", _HOLES + " SELECT vec_id FROM h GROUP BY 1 HAVING count(v) = count(*)")
def drop_nan_rows(spark, d):
    return cluster.complete_rows(_holes(spark, d)).select("vec_id")


@query("group_mean", MEAN + " SELECT label, dim, round(v, 6) AS value, n FROM m")
def group_mean(spark, d):
    return long(cluster.group_means(vectors(spark, d), "label").withColumnRenamed("center", "features"), "label", "n")


@query("mean_encoding", E + ", g AS (SELECT p_brand AS species, dim, v FROM l JOIN part ON vec_id = p_partkey), n AS (SELECT species, dim, avg(v) AS v, count(*) AS n FROM g GROUP BY 1, 2) SELECT species, dim, round(v, 6) AS value, n FROM n WHERE n >= 5")
def mean_encoding(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("vec_id"), F.col("p_brand").alias("species"))
    return long(cluster.group_means(vectors(spark, d).join(part, "vec_id"), "species", 5).withColumnRenamed("center", "features"), "species", "n")


@query("exemplar_nearest", MEAN + " SELECT label, vec_id, round(dist, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) = 1")
def exemplar_nearest(spark, d):
    return rounded(cluster.exemplars(vectors(spark, d), "label", "vec_id"))


@query("nearest_20", MEAN + " SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id)::INT AS rank FROM d QUALIFY rank <= 20")
def nearest_20(spark, d):
    """Twenty rows a group: a top-k report."""
    return cluster.nearest_to_mean(vectors(spark, d), "label", "vec_id", 20)


@query("ch_score", E + ", g AS (SELECT label, dim, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM l GROUP BY 1, 2), a AS (SELECT dim, avg(v) AS a FROM l GROUP BY 1), t AS (SELECT sum(n * (m - a)**2) AS b, sum(ss) AS w, count(DISTINCT label) AS k FROM g JOIN a USING (dim)) SELECT round(b * ((SELECT count(*) FROM e) - k) / (w * (k - 1)), 6) AS ch FROM t")
def ch_score(spark, d):
    return rounded(cluster.calinski_harabasz(vectors(spark, d)))


@query("db_score", MEAN + ", s AS (SELECT label, avg(dist) AS s FROM d GROUP BY 1), c AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.v - b.v)**2)) AS dist FROM m a JOIN m b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT la, max((x.s + y.s) / dist) AS r FROM c JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY 1) SELECT round(avg(r), 6) AS db FROM r")
def db_score(spark, d):
    return rounded(cluster.davies_bouldin(vectors(spark, d)))


@query("silhouette_exact", E + """, p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.f, b.f)) AS s, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3), w AS (SELECT vec_id, la AS label, max(CASE WHEN la = lb THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM p GROUP BY 1, 2)
  SELECT vec_id, label::BIGINT AS label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM w""")
def silhouette_exact(spark, d):
    return rounded(cluster.silhouette(vectors(spark, d), "vec_id"))


@query("rank_sum", "s(n, ch, db) AS (VALUES (2, 10.0, 3.0), (3, 30.0, 1.0), (4, 20.0, 1.0), (5, 30.0, 2.0)), r AS (SELECT n, rank() OVER (ORDER BY ch DESC)::INT AS rank_ch, rank() OVER (ORDER BY db DESC)::INT AS rank_db FROM s) SELECT *, rank_ch + rank_db AS total FROM r")
def rank_sum(spark, d):
    return cluster.rank_sums(spark.createDataFrame([(2, 10.0, 3.0), (3, 30.0, 1.0), (4, 20.0, 1.0), (5, 30.0, 2.0)], "n int, ch double, db double"))


@query("unique_collapse", "u AS (SELECT l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, l_quantity, l_discount, (l_quantity > 25)::INT AS label FROM lineitem")
def unique_collapse(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    cols = ["l_quantity", "l_discount"]
    labelled = cluster.collapsed(line, cols).withColumn("label", (F.col("l_quantity") > 25).cast("int"))
    return cluster.spread_back(line, labelled, cols).select("l_orderkey", "l_linenumber", *cols, "label")


_LINE = "t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 6)::INT AS label, l_suppkey, l_quantity, l_discount, l_extendedprice AS distance FROM lineitem)"


def _lines(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 6).cast("int").alias("label"), "l_suppkey", "l_quantity", "l_discount", F.col("l_extendedprice").alias("distance"))


@query("centroid_replace", _LINE + ", m AS (SELECT label, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM t GROUP BY 1) SELECT l_orderkey, l_linenumber, t.label, m.l_quantity, m.l_discount FROM t JOIN m ON t.label = m.label")
def centroid_replace(spark, d):
    return rounded(cluster.centroid_values(_lines(spark, d).select("l_orderkey", "l_linenumber", "label", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]))


@query("outlier_pct", _LINE + ", p AS (SELECT quantile_cont(distance, 0.95) AS q FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN distance > q THEN -1 ELSE label END AS label FROM t, p")
def outlier_pct(spark, d):
    return cluster.outliers_marked(_lines(spark, d), 95).select("l_orderkey", "l_linenumber", "label")


@query("merge_labels", _LINE + " SELECT l_orderkey, l_linenumber, CASE label WHEN 2 THEN 1 WHEN 4 THEN 3 ELSE label END AS label FROM t")
def merge_labels(spark, d):
    return cluster.merged_labels(_lines(spark, d), "1,2;3,4").select("l_orderkey", "l_linenumber", "label")


@query("select_labels", _LINE + " SELECT l_orderkey, l_linenumber, label FROM t WHERE label IN (1, 4)")
def select_labels(spark, d):
    return cluster.selected(_lines(spark, d), "1,4, 5").select("l_orderkey", "l_linenumber", "label")


@query("largest_cluster", _LINE + ", n AS (SELECT l_suppkey, label, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT l_suppkey, label, sum(n) OVER (PARTITION BY l_suppkey) AS al, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, label) AS k FROM n) SELECT l_orderkey, l_linenumber, l_suppkey, label FROM t JOIN b USING (l_suppkey, label) WHERE k = 1 OR al < 5")
def largest_cluster(spark, d):
    return cluster.largest_cluster(_lines(spark, d), "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "label")


@query("fuzzy_labels", _LINE + ", p AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS a, 1 - l_discount * 5 AS b FROM t) SELECT l_orderkey, l_linenumber, CASE WHEN greatest(a, b) < 0.7 THEN -1 WHEN a >= b THEN 0 ELSE 1 END AS label FROM p")
def fuzzy_labels(spark, d):
    a = F.col("l_discount") * 5
    return cluster.fuzzy_labels(_lines(spark, d).withColumn("probability", F.array(a, F.lit(1.0) - a)), 0.7).select("l_orderkey", "l_linenumber", "label")


@query("morph_labels", "p AS (SELECT p_partkey AS img_id, p_brand AS species, p_size % 3 AS label FROM part) SELECT img_id, concat(species, '_', label) AS morph FROM p SEMI JOIN (SELECT species FROM p GROUP BY 1 HAVING count(*) >= 20) USING (species)")
def morph_labels(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("img_id"), F.col("p_brand").alias("species"), (F.col("p_size") % 3).alias("label"))
    return cluster.morph_labels(p).select("img_id", "morph")


@query("text_rank", E + """, t AS (SELECT concat('t', vec_id) AS text, f FROM e WHERE vec_id < 8), z AS (SELECT vec_id AS img_id, text, 100 * list_cosine_similarity(e.f, t.f) AS z FROM e, t), m AS (SELECT img_id, max(z) AS m, arg_max(text, (z, text)) AS text FROM z GROUP BY 1) SELECT m.img_id, m.text, round(1 / sum(exp(z - m)), 6) AS probability FROM m JOIN z USING (img_id) GROUP BY 1, 2""")
def text_rank(spark, d):
    v = vectors(spark, d)
    return rounded(cluster.softmax_choice(v.withColumnRenamed("vec_id", "img_id"), v.where("vec_id < 8").withColumn("text", F.concat(F.lit("t"), F.col("vec_id").cast("string")))))


# Fits: labels depend on the start, so tests check their properties.


@query("kmeans_fit")
def kmeans_fit(spark, d):
    return cluster.fitted(vectors(spark, d).drop("label"), "kmeans", 10)[0].select("vec_id", "label")


@query("gmm_fit")
def gmm_fit(spark, d):
    return cluster.fitted(vectors(spark, d).drop("label"), "gaussian_mixture", 3)[0].select("vec_id", "label", "probability")


@query("pca_exemplar")
def pca_exemplar(spark, d):
    v = cluster.imputed(vectors(spark, d))
    return rounded(cluster.exemplars(cluster.principal_components(v, 20, "vec_id"), "label", "vec_id"))


@query("agglomerative_groups")
def agglomerative_groups(spark, d):
    return _grouped(spark, d, "agglomerative", n=3)


@query("dbscan_groups")
def dbscan_groups(spark, d):
    return _grouped(spark, d, "dbscan", eps=1.2, least=4)


@query("hdbscan_groups")
def hdbscan_groups(spark, d):
    return _grouped(spark, d, "hdbscan")


@query("tsne_groups")
def tsne_groups(spark, d):
    return _grouped(spark, d, "tsne", rounds=250)


_NEAR = E + ", p AS (SELECT a.vec_id, list_distance(a.f, b.f) AS d FROM e a, e b), k AS (SELECT vec_id, d AS distance FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) = 4)"


@query("k_distances", _NEAR + " SELECT vec_id, round(distance, 6) AS distance FROM k")
def k_distances(spark, d):
    return rounded(blocks.k_distances(vectors(spark, d), "vec_id", 4))


@query("knee_radius", _NEAR + ", c AS (SELECT distance, row_number() OVER (ORDER BY distance, vec_id) AS i FROM k), z AS (SELECT min(distance) AS lo, max(distance) AS hi, count(*) AS n FROM c) SELECT round(distance, 6) AS eps FROM c, z ORDER BY abs(lo + (hi - lo) * (i - 1) / (n - 1) - distance) DESC, i LIMIT 1")
def knee_radius(spark, d):
    """The one distance at the knee."""
    return rounded(cluster.knee_radius(vectors(spark, d), "vec_id", 4))


@query("affinity_groups")
def affinity_groups(spark, d):
    return _grouped(spark, d, "affinity")


def _grouped(spark, d, algorithm, **options):
    return kernels.cluster_groups(vectors(spark, d).withColumnRenamed("label", "species"), "species", "vec_id", algorithm, **options)
