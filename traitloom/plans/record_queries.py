"""Record queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import masks, metrics, records
from ..sources import records as sources
from .pixel_queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def stages(spark, d):
    """images: documents; masks: labels; segments: labels of quality 1."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select(F.col("doc_id").alias("img_id")), labels.select(F.col("doc_id").alias("img_id")), labels.where("quality = 1").select(F.col("doc_id").alias("img_id"))


@query("occ_media_first", "WITH m AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) SELECT o_orderkey AS l_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, l_shipmode FROM orders JOIN m ON o_orderkey = l_orderkey".replace("l_shipmode", "l_returnflag"))
def occ_media_first(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return records.occurrences_with_media(o, m, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")


@query("metrics_left", "WITH a AS (SELECT l_partkey AS img_id, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS img_id, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_partkey AS img_id, mean_quantity, n_returned FROM part LEFT JOIN a ON a.img_id = p_partkey LEFT JOIN b ON b.img_id = p_partkey")
def metrics_left(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "img_id")
    a = line.groupBy("img_id").agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    b = line.where("l_returnflag = 'R'").groupBy("img_id").agg(F.count("*").alias("n_returned"))
    return records.with_metrics(table(spark, d, "part").select(F.col("p_partkey").alias("img_id")), a, b)


for _how in ("inner", "left"):
    query(f"records_{_how}", f"SELECT l_partkey AS obs_id, l_orderkey, l_linenumber, p_brand AS species FROM lineitem {_how.upper()} JOIN (SELECT * FROM part WHERE p_size % 2 = 0) p ON l_partkey = p_partkey")(
        lambda spark, d, how=_how: records.with_records(table(spark, d, "lineitem").select(F.col("l_partkey").alias("obs_id"), "l_orderkey", "l_linenumber"), table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("obs_id"), F.col("p_brand").alias("species")), how=how)
    )


@query("group_left_dedup", "WITH m AS (SELECT l_orderkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) = 1) SELECT o_orderkey AS obs_id, l_returnflag FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")
def group_left_dedup(spark, d):
    rec = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obs_id"), "l_linenumber", "l_returnflag")
    out = records.first_per_key(rec.select("obs_id", "l_linenumber", "l_returnflag"), ["obs_id"], ["l_linenumber", "l_returnflag"])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("obs_id")).join(out.select("obs_id", "l_returnflag"), "obs_id", "left")


@query("enc_records", "SELECT vec_id AS img_id, label, p_brand AS species FROM embeddings JOIN part ON vec_id = p_partkey")
def enc_records(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), "label").join(table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_brand").alias("species")), "img_id")


@query("outer_fill", "WITH a AS (SELECT doc_id AS id, quality FROM labels), b AS (SELECT vec_id AS id, label AS toxic FROM embeddings) SELECT coalesce(a.id, b.id) AS id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM a FULL JOIN b ON a.id = b.id")
def outer_fill(spark, d):
    left = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return records.outer_filled(left, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("toxic")), "id")


@query("lookup_ordered", "SELECT o_orderkey AS pos, o_custkey AS c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_ordered(spark, d):
    want = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("c_custkey"))
    return records.lookup_ordered(want, table(spark, d, "customer"), "c_custkey", "c_mktsegment")


@query("anti_existing", "SELECT doc_id AS img_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_existing(spark, d):
    images, done, _ = stages(spark, d)
    return records.not_existing(images, done, "img_id")


@query("stage_diff", "SELECT doc_id AS img_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def stage_diff(spark, d):
    failed = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("img_id"))
    images, _, segments = stages(spark, d)
    return records.to_mask(images, segments, failed)


@query("stage_intersect", "SELECT doc_id AS img_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stage_intersect(spark, d):
    images, _, segments = stages(spark, d)
    return records.existing(images, segments, "img_id")


@query("stage_union", "SELECT doc_id AS img_id FROM labels WHERE toxic = 1 UNION SELECT vec_id FROM embeddings")
def stage_union(spark, d):
    return records.united_ids(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("img_id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id")))


@query("good_bad", "WITH g AS (SELECT DISTINCT doc_id AS img_id FROM labels WHERE toxic = 1), b AS (SELECT DISTINCT doc_id AS img_id FROM labels WHERE doc_id NOT IN (SELECT img_id FROM g)), r AS (SELECT img_id, row_number() OVER (ORDER BY md5(concat(img_id, ':1')), img_id) AS k FROM b) SELECT img_id, true AS good FROM g UNION ALL SELECT img_id, false FROM r WHERE k <= (SELECT count(*) FROM g)")
def good_bad(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "img_id")
    return records.good_and_bad(labels.where("toxic = 1"), labels)


@query("union_missing_cols", "SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, NULL::BIGINT AS suppkey FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier")
def union_missing_cols(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("suppkey"))
    return records.stacked(c, s)


@query("merged_sources", "SELECT c_custkey AS k, concat('CUST-', c_custkey) AS recordID, 'customers' AS dataSource FROM customer UNION ALL SELECT s_suppkey, concat('SUPP-', s_suppkey), 'suppliers' FROM supplier")
def merged_sources(spark, d):
    return records.merged_sources([(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", "CUST-", "customers"), (table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k", "SUPP-", "suppliers")])


@query("records_eq", "SELECT p_partkey AS img_id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size > 10")
def records_eq(spark, d):
    part = table(spark, d, "part")
    brand = part.agg(F.min("p_brand").alias("b"))
    return part.join(F.broadcast(brand), F.col("p_brand") == F.col("b")).where("p_size > 10").select(F.col("p_partkey").alias("img_id"))  # one row: a scalar


@query("multi_source", "SELECT doc_id AS img_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND contains(doc_id::VARCHAR, '1')")
def multi_source(spark, d):
    images, _, _ = stages(spark, d)
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "img_id")
    return records.filtered_ids(images, within=[(labels, {"quality": 1})], outside=[(labels, {"toxic": 1})], contains="1")


@query("bbox", "WITH p AS (SELECT c_custkey, (c_custkey*7919 % 18000)/100.0::DOUBLE - 90 AS latitude, (c_custkey*104729 % 36000)/100.0::DOUBLE - 180 AS longitude FROM customer) SELECT c_custkey, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM p WHERE latitude BETWEEN 24.396308 AND 49.384358 AND longitude BETWEEN -124.848974 AND -66.885444")
def bbox(spark, d):
    k = F.col("c_custkey")
    return rounded(records.in_box(table(spark, d, "customer").select(k, (k * 7919 % 18000 / 100.0 - 90).alias("latitude"), (k * 104729 % 36000 / 100.0 - 180).alias("longitude"))))


@query("url_present", "SELECT page_id FROM pages WHERE url IS NOT NULL AND url <> ''")
def url_present(spark, d):
    return records.with_link(table(spark, d, "pages"), "url").select("page_id")


@query("gif_filter", "WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat(url, '.gif') WHEN page_id % 4 = 1 THEN 'gif' ELSE url END AS u FROM pages) SELECT page_id FROM p WHERE NOT regexp_matches(u, '.gif')")
def gif_filter(spark, d):
    u = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit(".gif"))).when(F.col("page_id") % 4 == 1, F.lit("gif")).otherwise(F.col("url"))
    return records.without_gif(table(spark, d, "pages").select("page_id", u.alias("img_url"))).select("page_id")


@query("quality_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def quality_filter(spark, d):
    return records.matching(table(spark, d, "events"), {"event_type": "purchase"}).select("event_id", "user_id")


@query("keep_rename", "SELECT p_partkey AS img_id, p_name AS species, split_part(p_name, ' ', 1) AS genus FROM part")
def keep_rename(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.col("p_name").alias("species"), ids.genus_of(F.col("p_name")).alias("genus"))


@query("img_size", "WITH u AS (SELECT page_id, concat(url, CASE WHEN page_id % 2 = 0 THEN '/square.jpg' ELSE '/original.jpg' END) AS u FROM pages) SELECT page_id, replace(replace(u, '/square.', '/medium.'), 'original', 'medium') AS u FROM u")
def img_size(spark, d):
    u = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/square.jpg").otherwise("/original.jpg"))
    return table(spark, d, "pages").select("page_id", ids.sized_url(u, "medium").alias("u"))


_OCC = "SELECT p_partkey AS k, concat(CASE WHEN p_partkey % 3 = 0 THEN 'https://observation.org/observation/' WHEN p_partkey % 3 = 1 THEN 'https://www.inaturalist.org/observations/' END, p_partkey) AS occurrenceID, p_brand AS datasetName FROM part"


@query("source_prefix", f"WITH o AS (SELECT k, CASE WHEN k % 3 <> 2 THEN occurrenceID END AS occurrenceID, datasetName FROM ({_OCC})) SELECT k, CASE WHEN coalesce(regexp_matches(occurrenceID, 'observation.org'), false) THEN 'Observation.org' ELSE datasetName END AS datasetName, regexp_extract(occurrenceID, '([^/]*)$', 1) AS catalogNumber, CASE WHEN occurrenceID IS NOT NULL THEN concat(CASE WHEN regexp_matches(occurrenceID, 'observation.org') THEN 'OBS-' ELSE 'INAT-' END, regexp_extract(occurrenceID, '([^/]*)$', 1)) END AS img_id FROM o")
def source_prefix(spark, d):
    k = F.col("p_partkey")
    host = F.when(k % 3 == 0, "https://observation.org/observation/").when(k % 3 == 1, "https://www.inaturalist.org/observations/")
    o = table(spark, d, "part").select(k.alias("k"), F.concat(host, k.cast("string")).alias("occurrenceID"), F.col("p_brand").alias("datasetName"))
    return records.darwin_core_source(o).select("k", "datasetName", "catalogNumber", "img_id")


@query("id_parse", """WITH n AS (SELECT p_partkey AS k, concat('INAT-', p_partkey, '-', p_size, CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '_mask.png' WHEN 2 THEN '_segment.png' ELSE '' END) AS name FROM part),
  i AS (SELECT k, name, regexp_replace(replace(replace(name, '.jpg', ''), '.png', ''), '_[^_]*$', '') AS img_id FROM n)
  SELECT k, img_id, regexp_replace(img_id, '-[^-]*$', '') AS obs_id, regexp_replace(img_id, '-1$', '') AS metric_obs_id, concat(split_part(img_id, '-', 1), '-', split_part(img_id, '-', 2)) AS record_id, concat(img_id, '_mask.png') AS mask_name,
  CASE WHEN contains(name, '_segment') THEN 'segment' WHEN contains(name, '_mask') THEN 'mask' ELSE 'image' END AS stage FROM i""")
def id_parse(spark, d):
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, ".jpg").when(k % 4 == 1, "_mask.png").when(k % 4 == 2, "_segment.png").otherwise("")
    n = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("INAT-"), k.cast("string"), F.lit("-"), F.col("p_size").cast("string"), end).alias("name"))
    n = n.withColumn("img_id", ids.image_id(F.col("name")))
    i = F.col("img_id")
    return n.select("k", "img_id", ids.observation_id(i).alias("obs_id"), ids.metric_observation_id(i).alias("metric_obs_id"), ids.record_id(i).alias("record_id"), ids.image_file(i, "mask").alias("mask_name"), ids.stage_of(F.col("name")).alias("stage"))


@query("path_name", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def path_name(spark, d):
    return table(spark, d, "pages").select("page_id", ids.file_name(F.col("url")).alias("name"))


@query("download_requests", "SELECT CASE WHEN page_id % 2 = 0 THEN concat('INAT-', page_id, '-1') ELSE concat('OBS-', regexp_extract(url, '([^/]*)$', 1)) END AS key, url AS img_url FROM pages WHERE url IS NOT NULL AND url <> ''")
def download_requests(spark, d):
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.col("page_id").cast("string"), F.lit("-1.jpg")))
    return sources.download_requests(table(spark, d, "pages").select(name.alias("file_name"), F.col("url").alias("img_url")))


@query("sample_n_hash", "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat(p_partkey, ':1')), p_partkey) <= 3")
def sample_n_hash(spark, d):
    """A sampling operator: three rows a group."""
    return records.sample_per_group(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 3, "p_partkey")


@query("lim_sample", "SELECT p_partkey FROM part ORDER BY md5(concat(p_partkey, ':5')), p_partkey LIMIT 50")
def lim_sample(spark, d):
    """A sampling operator."""
    return records.sampled(table(spark, d, "part").select("p_partkey"), "p_partkey", 50, 5)


@query("first_n_min_class", "WITH n AS (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 20), k AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS img_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem SEMI JOIN n USING (l_suppkey)) SELECT l_suppkey, img_id FROM k WHERE k <= 5")
def first_n_min_class(spark, d):
    line = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("img_id"))
    return records.first_n_per_group(line, "l_suppkey", 5, 20, "img_id")


@query("split_fraction", "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, ':1')), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= ceil(round(n * 0.8, 6)) THEN 'Train' ELSE 'Test' END AS part FROM k")
def split_fraction(spark, d):
    return records.split_train_test(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query("chunk_ids", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk FROM orders")
def chunk_ids(spark, d):
    return records.chunked(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("seq_path", "SELECT coalesce(max(try_cast(regexp_extract(name, '_([0-9]+)[.]', 1) AS INT)) + 1, 0) AS next FROM (SELECT concat('collage_', p_size, '.png') AS name FROM part)")
def seq_path(spark, d):
    return records.next_suffix(table(spark, d, "part").select(F.concat(F.lit("collage_"), F.col("p_size").cast("string"), F.lit(".png")).alias("name")), "collage")


@query("codings_upsert", "WITH a AS (SELECT doc_id::VARCHAR AS id, quality::VARCHAR AS q, 'old' AS t FROM labels), b AS (SELECT vec_id::VARCHAR AS id, NULL::VARCHAR AS q, 'new' AS t FROM embeddings) SELECT coalesce(a.id, b.id) AS id, coalesce(b.q, a.q) AS q, coalesce(b.t, a.t) AS t FROM a FULL JOIN b ON a.id = b.id")
def codings_upsert(spark, d):
    old = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("q"), F.lit("old").alias("t"))
    new = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("string").alias("q"), F.lit("new").alias("t"))
    return records.merged_codings(old, new, ["q", "t"])


@query("vocabulary", "WITH t AS (SELECT r_regionkey::BIGINT AS id, r_name AS label FROM region UNION SELECT n_nationkey + 100, n_name FROM nation) SELECT id, label FROM t")
def vocabulary(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("label"))).alias("values"))
    terms = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("label"), "values")
    return records.vocabulary(terms)


@query("taxon_ids", "WITH w AS (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier), n AS (SELECT name, CASE WHEN len(string_split(name, ' ')) = 2 THEN 'species' ELSE 'genus' END AS rank FROM w), t AS (SELECT p_name AS name, CASE WHEN len(string_split(p_name, ' ')) = 2 THEN 'species' ELSE 'genus' END AS rank, min(p_partkey) AS taxon_id FROM part GROUP BY 1, 2) SELECT n.name, n.rank, coalesce(taxon_id, -1) AS taxon_id FROM n LEFT JOIN t ON t.name = n.name AND t.rank = n.rank")
def taxon_ids(spark, d):
    part = table(spark, d, "part")
    rank = F.when(F.size(F.split("p_name", " ")) == 2, "species").otherwise("genus")
    names = part.select(F.col("p_name").alias("name")).union(table(spark, d, "supplier").select("s_name")).distinct()
    return records.taxon_ids(names, part.select(F.col("p_name").alias("name"), rank.alias("rank"), F.col("p_partkey").alias("taxon_id")))


@query("record_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def record_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("genera_min_count", "SELECT p_type AS genus, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 30")
def genera_min_count(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("genus")).agg(F.count("*").alias("n")).where("n >= 30")


@query("genus_list", "SELECT DISTINCT split_part(p_name, ' ', 1) AS genus FROM part")
def genus_list(spark, d):
    return table(spark, d, "part").select(ids.genus_of(F.col("p_name")).alias("genus")).distinct()


@query("new_observations", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0) GROUP BY 1")
def new_observations(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return records.first_per_key(records.not_existing(e, e.where("event_type = 'purchase' AND user_id % 2 = 0"), "user_id").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("stage_status", """WITH s AS (SELECT concat('INAT-', doc_id, '-1') AS img_id, 'image' AS stage FROM documents UNION ALL SELECT concat('INAT-', doc_id, '-1'), 'mask' FROM labels UNION ALL SELECT concat('INAT-', doc_id, '-1'), 'segment' FROM labels WHERE quality = 1),
  n AS (SELECT stage, count(*) AS images, count(DISTINCT img_id) AS observations FROM s GROUP BY 1) SELECT stage, images, observations, round(images * 100.0::DOUBLE / (SELECT images FROM n WHERE stage = 'image')) AS percent FROM n""")
def stage_status(spark, d):
    names = ("image", "mask", "segment")
    s = [t.select(F.concat(F.lit("INAT-"), F.col("img_id").cast("string"), F.lit("-1")).alias("img_id"), F.lit(n).alias("stage")) for n, t in zip(names, stages(spark, d), strict=True)]
    return records.stage_status(records.stacked(*s))


_TRIALS = "t AS (SELECT concat('u', user_id % 20) AS user_name, event_id % 7 = 0 AS timed_out, event_type <> 'view' AS found, value AS reaction_time_seconds FROM events)"


@query("trial_summary", f"WITH {_TRIALS} SELECT user_name, count(*) AS total, sum((NOT timed_out)::INT)::BIGINT AS completed, sum((found AND NOT timed_out)::INT)::BIGINT AS found, round(avg(CASE WHEN found AND NOT timed_out THEN reaction_time_seconds END), 6) AS mean_reaction, round(sum((found AND NOT timed_out)::INT) / sum((NOT timed_out)::INT), 6) AS accuracy FROM t GROUP BY 1")
def trial_summary(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_name"), (F.col("event_id") % 7 == 0).alias("timed_out"), (F.col("event_type") != "view").alias("found"), F.col("value").alias("reaction_time_seconds"))
    return rounded(records.trial_summary(e))


_PRED = "p AS (SELECT quality AS label, (doc_id % 3 > 0)::INT AS predicted, (doc_id % 10) / 10.0::DOUBLE AS score FROM labels)"


def _predictions(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), (F.col("doc_id") % 3 > 0).cast(table(spark, d, "labels").schema["quality"].dataType).alias("predicted"), (F.col("doc_id") % 10 / 10.0).alias("score"))


@query("confusion", f"WITH {_PRED} SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, d):
    return records.confusion(_predictions(spark, d))


@query("class_report", f"WITH {_PRED}, k AS (SELECT DISTINCT label AS k FROM p UNION SELECT predicted FROM p) SELECT k AS label, round(sum((label = k AND predicted = k)::INT) / nullif(sum((predicted = k)::INT), 0), 6) AS precision, round(sum((label = k AND predicted = k)::INT) / nullif(sum((label = k)::INT), 0), 6) AS recall, round(2.0 * sum((label = k AND predicted = k)::INT) / (sum((label = k)::INT) + sum((predicted = k)::INT)), 6) AS f1, sum((label = k)::INT)::BIGINT AS support FROM p, k GROUP BY k")
def class_report(spark, d):
    return rounded(records.class_report(_predictions(spark, d)))


@query("auroc", f"WITH {_PRED}, n AS (SELECT score, sum((label = 1)::INT) AS p, sum((label = 0)::INT) AS n FROM p GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) AS auroc FROM c")
def auroc(spark, d):
    return rounded(records.auroc(_predictions(spark, d)))


_BOX = "bx AS (SELECT l_orderkey AS img_id, l_linenumber::BIGINT AS box_id, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 50)::DOUBLE AS y0, (l_partkey % 50 + 10 + l_quantity)::DOUBLE AS x1, (l_suppkey % 50 + 10 + l_quantity)::DOUBLE AS y1 FROM lineitem)"
_IOU = "(greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)))"
_IOU = f"{_IOU} / ((a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) - {_IOU})"


def _boxes(spark, d):
    q = F.col("l_quantity") + 10
    x, y = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("img_id"), F.col("l_linenumber").cast("long").alias("box_id"), x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + q).alias("y1"))


@query("iou_pairs", f"WITH {_BOX} SELECT a.img_id, a.box_id AS a, b.box_id AS b, round({_IOU}, 6) AS iou FROM bx a JOIN bx b ON a.img_id = b.img_id AND a.box_id < b.box_id WHERE {_IOU} >= 0.3")
def iou_pairs(spark, d):
    return rounded(masks.iou_pairs(_boxes(spark, d), 0.3))


@query("iou_box_prompt", f"WITH {_BOX}, c AS (SELECT a.img_id, a.box_id AS prompt_id, b.box_id AS mask_id, {_IOU} AS iou FROM bx a JOIN bx b ON a.img_id = b.img_id AND a.box_id % 2 = 0 AND b.box_id % 2 = 1) SELECT img_id, prompt_id, mask_id, round(iou, 6) AS iou FROM c QUALIFY row_number() OVER (PARTITION BY img_id, prompt_id ORDER BY iou DESC, mask_id) = 1")
def iou_box_prompt(spark, d):
    b = _boxes(spark, d)
    return rounded(masks.best_masks_for_boxes(b.where("box_id % 2 = 1"), b.where("box_id % 2 = 0")))


@query("collage_places", "SELECT doc_id AS img_id, (doc_id % 12) * 64 AS x, (doc_id // 12) * 48 AS y FROM documents")
def collage_places(spark, d):
    return masks.collage_places(table(spark, d, "documents").select(F.col("doc_id").alias("img_id"), F.col("doc_id").alias("ordinal")), 12, (64, 48))


# Suppression, masks and prompts.

_NMS = _BOX + ", s AS (SELECT *, (box_id * 7919 + img_id * 13) % 101 AS score FROM bx), r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, box_id, x0, y0, x1, y1) AS k FROM s)"


@query("boxes_kept", f"""WITH RECURSIVE {_NMS}, o AS (SELECT a.img_id, a.k, list(b.k) AS over FROM r a JOIN r b ON a.img_id = b.img_id AND b.k < a.k AND {_IOU} > 0.4 GROUP BY 1, 2), f AS (SELECT r.img_id, r.k, r.box_id, coalesce(over, []) AS over FROM r LEFT JOIN o ON o.img_id = r.img_id AND o.k = r.k),
  w(img_id, k, kept, ids) AS (SELECT img_id, k, [k], [box_id] FROM f WHERE k = 1 UNION ALL SELECT f.img_id, f.k, CASE WHEN list_has_any(kept, f.over) THEN kept ELSE list_append(kept, f.k) END, CASE WHEN list_has_any(kept, f.over) THEN ids ELSE list_append(ids, f.box_id) END FROM w JOIN f ON f.img_id = w.img_id AND f.k = w.k + 1)
  SELECT img_id, unnest(ids) AS box_id FROM w QUALIFY k = max(k) OVER (PARTITION BY img_id)""")
def boxes_kept(spark, d):
    scored = _boxes(spark, d).withColumn("score", (F.col("box_id") * 7919 + F.col("img_id") * 13) % 101)
    return masks.boxes_kept(scored, 0.4)


#: Four rectangular masks an image.
_MASK = """k AS (SELECT p_partkey AS img_id, m AS mask_id, (p_partkey * (m + 3)) % 6 AS y0, (p_partkey * (m + 5)) % 7 AS x0, 2 + (p_partkey + m * m) % 9 AS h, 2 + (p_partkey * 3 + m) % 8 AS w FROM part, range(4) t(m)),
  mk AS (SELECT img_id, mask_id, y, x FROM k, range(20) a(y), range(20) b(x) WHERE y >= y0 AND y < y0 + h AND x >= x0 AND x < x0 + w), ar AS (SELECT img_id, mask_id, count(*) AS area FROM mk GROUP BY 1, 2)"""


def _masks(spark, d):
    p, m = F.col("p_partkey"), F.col("m")
    k = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("m"))
    k = k.select(p.alias("img_id"), m.alias("mask_id"), (p * (m + 3) % 6).alias("y0"), (p * (m + 5) % 7).alias("x0"), ((p + m * m) % 9 + 2).alias("h"), ((p * 3 + m) % 8 + 2).alias("w"))
    side = lambda a, n: F.explode(F.sequence(F.col(a), F.col(a) + F.col(n) - 1))
    return k.select("*", side("y0", "h").alias("y")).select("img_id", "mask_id", "y", side("x0", "w").alias("x"))


@query("masks_not_inside", f"WITH {_MASK}, o AS (SELECT a.img_id, a.mask_id AS a, b.mask_id AS b, count(*) AS n FROM mk a JOIN mk b USING (img_id, y, x) WHERE a.mask_id <> b.mask_id GROUP BY 1, 2, 3), g AS (SELECT o.img_id, b FROM o JOIN ar p ON p.img_id = o.img_id AND p.mask_id = a JOIN ar q ON q.img_id = o.img_id AND q.mask_id = b WHERE q.area < p.area AND n / q.area > 0.8) SELECT img_id, mask_id FROM ar WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.img_id = ar.img_id AND g.b = ar.mask_id)")
def masks_not_inside(spark, d):
    return masks.masks_not_inside(_masks(spark, d))


_PROMPT = ", pr AS (SELECT p_partkey AS img_id, b AS box_id, (p_partkey + b) % 5 AS y0, (p_partkey * 2 + b) % 5 AS x0, 5 + (p_partkey + b) % 5 + b * 3 AS y1, 5 + (p_partkey * 2 + b) % 5 + b AS x1 FROM part, range(2) t(b))"


@query("masks_for_boxes", f"WITH {_MASK}{_PROMPT}, i AS (SELECT pr.img_id, box_id, mask_id, count(*) AS n FROM pr JOIN mk USING (img_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2, 3), c AS (SELECT pr.img_id, box_id, ar.mask_id, coalesce(n, 0) / ((x1 - x0) * (y1 - y0) + area - coalesce(n, 0)) AS iou FROM pr JOIN ar USING (img_id) LEFT JOIN i USING (img_id, box_id, mask_id)), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY img_id, box_id ORDER BY iou DESC, mask_id) = 1) SELECT DISTINCT img_id, mask_id FROM t")
def masks_for_boxes(spark, d):
    p, b = F.col("img_id"), F.col("box_id")
    prompts = table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("box_id"))
    prompts = prompts.select("*", ((p + b) % 5).alias("y0"), ((p * 2 + b) % 5).alias("x0"))
    return masks.masks_for_boxes(_masks(spark, d), prompts.select("*", (F.col("y0") + 5 + b * 3).alias("y1"), (F.col("x0") + 5 + b).alias("x1")))


@query("mask_by_points", f"WITH {_MASK}, pt AS (SELECT p_partkey AS img_id, o AS ordinal, (p_partkey + o * 3) % 9 AS y, (p_partkey * 5 + o) % 9 AS x, CASE WHEN (p_partkey + o) % 3 = 0 THEN 0 ELSE 1 END AS label FROM part, range(3) t(o)), h AS (SELECT mk.img_id, mask_id, arg_max(label, ordinal) AS label FROM mk JOIN pt USING (img_id, y, x) GROUP BY 1, 2), e AS (SELECT mk.*, label, area FROM mk JOIN h USING (img_id, mask_id) JOIN ar USING (img_id, mask_id)), z AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY img_id, y, x ORDER BY area, mask_id DESC) = 1) SELECT img_id, y, x FROM z WHERE label = 1")
def mask_by_points(spark, d):
    p, o = F.col("img_id"), F.col("ordinal")
    points = table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("ordinal"))
    return masks.mask_by_points(_masks(spark, d), points.select("*", ((p + o * 3) % 9).alias("y"), ((p * 5 + o) % 9).alias("x"), F.when((p + o) % 3 == 0, 0).otherwise(1).alias("label")))


_LINES = """pg AS (SELECT * FROM (VALUES (0, 0, 0), (1, 10, 0), (2, 10, 10), (3, 5, 4), (4, 0, 10)) v(ordinal, x, y)), sd AS (SELECT a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM pg a JOIN pg b ON b.ordinal = (a.ordinal + 1) % 5),
  ln AS (SELECT l_orderkey AS img_id, l_linenumber AS line_id, l_partkey % 12 AS x0, l_suppkey % 11 AS y0, (l_partkey // 12) % 12 AS x1, (l_quantity::BIGINT) % 11 AS y1 FROM lineitem),
  pt AS (SELECT *, x0 * (1 - t) + x1 * t AS px, y0 * (1 - t) + y1 * t AS py FROM ln, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(t)),
  c AS (SELECT pt.*, (qx - ax) * (py - ay) - (qy - ay) * (px - ax) AS cr, ax, ay, qx, qy FROM pt, sd),
  i AS (SELECT img_id, line_id, x0, y0, x1, y1, t, bool_or(cr = 0 AND px BETWEEN least(ax, qx) AND greatest(ax, qx) AND py BETWEEN least(ay, qy) AND greatest(ay, qy)) OR sum(((ay > py) <> (qy > py) AND (cr > 0) = (qy > ay))::INT) % 2 = 1 AS inside FROM c GROUP BY ALL)
  SELECT img_id, line_id, x0, y0, x1, y1 FROM i GROUP BY ALL HAVING bool_and(inside)"""


@query("lines_inside", "WITH " + _LINES.replace("GROUP BY ALL HAVING", "GROUP BY 1, 2, 3, 4, 5, 6 HAVING").replace("FROM c GROUP BY ALL", "FROM c GROUP BY 1, 2, 3, 4, 5, 6, 7"))
def lines_inside(spark, d):
    """Equal lines are one, as in the SQL, which pools their crossings."""
    line = table(spark, d, "lineitem")
    lines = line.select(F.col("l_orderkey").alias("img_id"), F.col("l_linenumber").alias("line_id"), (F.col("l_partkey") % 12).alias("x0"), (F.col("l_suppkey") % 11).alias("y0"), (F.floor(F.col("l_partkey") / 12) % 12).alias("x1"), (F.col("l_quantity").cast("long") % 11).alias("y1"))
    once = lines.groupBy(*lines.columns).agg(F.count("*").alias("copies"))
    corners = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 10, 10), (3, 5, 4), (4, 0, 10)], "ordinal int, x int, y int")
    return masks.lines_inside(once, lines.select("img_id").distinct().join(F.broadcast(corners)), "copies").drop("copies")


@query("quantile_neighbours", "WITH v AS (SELECT p_partkey AS id, p_retailprice AS value FROM part), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM v), x AS (SELECT 0.25::DOUBLE AS quantile, id, value FROM v, q ORDER BY abs(value - a), value, id LIMIT 20), y AS (SELECT 0.5::DOUBLE AS quantile, id, value FROM v, q WHERE id NOT IN (SELECT id FROM x) ORDER BY abs(value - b), value, id LIMIT 20), z AS (SELECT 0.75::DOUBLE AS quantile, id, value FROM v, q WHERE id NOT IN (SELECT id FROM x UNION SELECT id FROM y) ORDER BY abs(value - c), value, id LIMIT 20) SELECT quantile, id AS p_partkey, value FROM (FROM x UNION ALL FROM y UNION ALL FROM z)")
def quantile_neighbours(spark, d):
    """Twenty rows a quantile: a top-k report."""
    return metrics.nearest_to_quantiles(table(spark, d, "part"), "p_partkey", "p_retailprice", (0.25, 0.5, 0.75), 20)


@query("chosen_exemplars", "WITH s AS (SELECT p_brand AS taxon, p_partkey AS img_id, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat(p_partkey, ':1')), p_partkey) - 1 AS ordinal FROM part), c AS (SELECT p_brand AS taxon, min(p_size) % 5 AS ordinal FROM part GROUP BY 1) SELECT taxon, img_id AS exemplar_img_id FROM s JOIN c USING (taxon, ordinal)")
def chosen_exemplars(spark, d):
    part = table(spark, d, "part")
    choices = part.groupBy(F.col("p_brand").alias("taxon")).agg((F.min("p_size") % 5).alias("ordinal"))
    return records.chosen_exemplars(part.select(F.col("p_brand").alias("taxon"), F.col("p_partkey").alias("img_id")), choices)
