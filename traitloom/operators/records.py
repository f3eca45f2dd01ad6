"""Record processing: normalising, joining, deduplicating, sampling and set operations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..storage import unused
from .metrics import numbered, ranges_in_order


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep-first: the least row of each key in an explicit order.  A partial minimum, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("m__"))
    return least.select(*keys, *[F.col(f"m__.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def occurrences_with_media(occurrence: DataFrame, media: DataFrame, key: str, media_order: list[str], link: str) -> DataFrame:
    """Occurrences with their first media row; rows without a link go."""
    return occurrence.join(first_per_key(media, [key], media_order), key, "left").where(F.col(link).isNotNull() & (F.col(link).cast("string") != ""))


def with_metrics(base: DataFrame, *tables: DataFrame, on: str = "img_id") -> DataFrame:
    """Left joins of several per-image tables."""
    out = base
    for t in tables:
        out = out.join(t, on, "left")
    return out


def with_records(metrics: DataFrame, records: DataFrame, on: str = "obs_id", how: str = "inner") -> DataFrame:
    """Metrics and records; columns that only differ in their table keep the metrics' name."""
    extra = [c for c in records.columns if c == on or c not in metrics.columns]
    return metrics.join(records.select(*extra), on, how)


def group_keys(images: DataFrame, records: DataFrame, group: str, order: list[str], on: str = "obs_id") -> DataFrame:
    """Each image with its record's group."""
    return images.join(first_per_key(records.select(on, *order, group), [on], order).select(on, group), on, "left")


def outer_filled(a: DataFrame, b: DataFrame, on: str, fill: int = -1) -> DataFrame:
    """Full outer join; gaps are filled by type."""
    out = a.join(b, on, "full")
    return out.fillna(fill).fillna(str(fill))


def lookup_ordered(ids_wanted: DataFrame, records: DataFrame, key: str, column: str) -> DataFrame:
    """(pos, key, column) of the wanted ids in order; unknown ids give null, repeats expand."""
    return ids_wanted.join(records.select(key, column), key, "left").select("pos", key, column)


def missing_ids(ids_wanted: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return ids_wanted.join(records, key, "left_anti")


def existing(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on), on, "left_semi")


def not_existing(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on), on, "left_anti")


def to_mask(images: DataFrame, masks: DataFrame, failed: DataFrame) -> DataFrame:
    """Ids that have neither a mask nor a failure yet."""
    return not_existing(images.select("img_id"), masks.select("img_id").union(failed.select("img_id")).distinct(), "img_id")


def united_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("img_id")
    for t in tables[1:]:
        out = out.union(t.select("img_id"))
    return out.distinct()


def good_and_bad(segments: DataFrame, masks: DataFrame, seed: int = 1) -> DataFrame:
    """(img_id, good): all segments, and as many masks without a segment, taken in hash order."""
    good = segments.select("img_id").distinct()
    n = good.count()
    bad = masks.select("img_id").distinct().subtract(good).orderBy(ids.hash_order(F.col("img_id"), seed), "img_id").limit(n)
    return good.withColumn("good", F.lit(True)).union(bad.withColumn("good", F.lit(False)))


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of tables with unlike columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def merged_sources(sources: Iterable[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(table, id column, prefix, name) each: recordID and dataSource are added, and all are stacked."""
    return stacked(*[t.withColumn("recordID", F.concat(F.lit(prefix), F.col(key).cast("string"))).withColumn("dataSource", F.lit(name)) for t, key, prefix, name in sources])


def matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal to every given value."""
    for k, v in wanted.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def filtered_ids(images: DataFrame, *, within: Iterable[tuple[DataFrame, dict]] = (), outside: Iterable[tuple[DataFrame, dict]] = (), contains: str | None = None) -> DataFrame:
    """Ids found in every `within` table under its conditions, in none of `outside`, and holding a substring."""
    out = images.select("img_id")
    for t, wanted in within:
        out = existing(out, matching(t, wanted), "img_id")
    for t, wanted in outside:
        out = not_existing(out, matching(t, wanted), "img_id")
    return out.where(F.contains(F.col("img_id").cast("string"), F.lit(contains))) if contains else out


#: A box around the contiguous United States, as south, west, north, east.
CONTIGUOUS_US = (24.396308, -124.848974, 49.384358, -66.885444)


def in_box(df: DataFrame, box: tuple[float, float, float, float] = CONTIGUOUS_US, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    south, west, north, east = box
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def with_link(df: DataFrame, column: str = "img_url") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def without_gif(df: DataFrame, column: str = "img_url") -> DataFrame:
    """Any character followed by `gif` counts, as a pattern."""
    return df.where(~F.col(column).rlike(".gif"))


def darwin_core_source(df: DataFrame) -> DataFrame:
    """datasetName and catalogNumber by where a record is from, and the image id."""
    observation = F.coalesce(F.col("occurrenceID").rlike("observation.org"), F.lit(False))
    name = F.when(observation, F.lit("Observation.org")).otherwise(F.col("datasetName"))
    number = F.substring_index("occurrenceID", "/", -1)
    return df.withColumn("datasetName", name).withColumn("catalogNumber", number).withColumn("img_id", F.concat(F.when(observation, F.lit("OBS-")).otherwise(F.lit("INAT-")), number))


def rebuilt_records(raw: DataFrame) -> DataFrame:
    """Raw observation rows in the common shape: one image an observation."""
    obs = F.concat(F.lit("INAT-"), F.col("obs_id").cast("string"))
    parts = lambda c: F.filter(F.split(F.col(c), ","), lambda x: x != "")
    return raw.select(
        obs.alias("obs_id"), F.concat(obs, F.lit("-1")).alias("img_id"), F.lit("inaturalist").alias("source"), F.col("taxon").alias("species"), ids.genus_of(F.col("taxon")).alias("genus"),
        F.lit(None).cast("string").alias("family"), F.expr("try_cast(latitude AS double)").alias("latitude"), F.expr("try_cast(longitude AS double)").alias("longitude"),
        F.expr("try_cast(date AS timestamp)").alias("observed_at"), F.col("img_url"), F.expr("try_cast(img_cnt AS int)").alias("img_cnt"), F.col("license"), parts("annotations").alias("annotations"), parts("tags").alias("tags"),
    )


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 1) -> DataFrame:
    """At most n rows a group in a reproducible random order; rows without a group go."""
    w = Window.partitionBy(group).orderBy(ids.hash_order(F.col(key), seed), key)
    return df.where(F.col(group).isNotNull()).withColumn("k__", F.row_number().over(w)).where(F.col("k__") <= n).drop("k__")


def first_n_per_group(df: DataFrame, group: str, most: int, least: int, order: str) -> DataFrame:
    """The first `most` rows of each group that has at least `least`."""
    w = Window.partitionBy(group)
    sizes = df.groupBy(group).agg(F.count("*").alias("n__")).where(F.col("n__") >= least)
    return df.join(sizes.select(group), group, "left_semi").withColumn("k__", F.row_number().over(w.orderBy(order))).where(F.col("k__") <= most).drop("k__")


def sampled(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    return df.orderBy(ids.hash_order(F.col(key), seed), key).limit(n)


def chosen_exemplars(images: DataFrame, choices: DataFrame, seed: int = 1) -> DataFrame:
    """taxon, exemplar_img_id: the image at the chosen ordinal (from 0) among those of its taxon, in a reproducible random order."""
    w = Window.partitionBy("taxon").orderBy(ids.hash_order(F.col("img_id"), seed), "img_id")
    shown = images.where(F.col("taxon").isNotNull()).withColumn("ordinal", F.row_number().over(w) - 1)
    return shown.join(choices, ["taxon", "ordinal"]).select("taxon", F.col("img_id").alias("exemplar_img_id"))


def split_train_test(df: DataFrame, key: str, test_share: float, seed: int = 1) -> DataFrame:
    """The first ceil(n * (1 - share)) rows in hash order train, the rest test."""
    n = df.count()
    o, k = unused(df, "o__", "k__")
    ordered = numbered(df.withColumn(o, ids.hash_order(F.col(key), seed)), [o, key], k)
    train = -int(-n * (1 - test_share) // 1)
    return ordered.withColumn("part", F.when(F.col(k) <= train, "Train").otherwise("Test")).drop(o, k)


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """A chunk number for every row: index div size, in order."""
    (k,) = unused(df, "k__")
    return numbered(df, order, k).withColumn("chunk", F.floor((F.col(k) - 1) / size).cast("long")).drop(k)


def next_suffix(names: DataFrame, prefix: str) -> DataFrame:
    """1 + the largest trailing number among names of a prefix, 0 without any."""
    number = F.expr("try_cast(regexp_extract(name, '_([0-9]+)[.]', 1) AS int)")
    return names.where(F.startswith(F.col("name"), F.lit(prefix))).agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("next"))


def merged_codings(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Upsert by id: a new value wins where there is one."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, "id", "full").select("id", *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns])


def vocabulary(terms: DataFrame) -> DataFrame:
    """(id, label) of terms and of their values alike, from (id, label, values array of (id, label))."""
    own = terms.select("id", "label")
    return own.union(terms.select(F.explode("values").alias("v")).select("v.id", "v.label")).distinct()


def named_annotations(df: DataFrame, names: DataFrame, column: str = "annotations") -> DataFrame:
    """`attribute:value` codes of each row with both labels."""
    each = df.withColumn("a__", F.explode(F.col(column)))
    pair = F.split(F.col("a__"), ":")
    attribute, value = names.select(F.col("id").alias("i"), F.col("label").alias("attribute")), names.select(F.col("id").alias("j"), F.col("label").alias("value"))
    return each.withColumn("i", pair[0]).withColumn("j", pair[1]).join(attribute, "i", "left").join(value, "j", "left").drop("a__", "i", "j")


def taxon_ids(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """Each wanted name with its taxon id: two words are a species, one a genus; first exact match, else -1."""
    rank = F.when(F.size(F.split("name", " ")) == 2, "species").otherwise("genus")
    hit = names.withColumn("rank", rank).join(taxa.select("name", "rank", "taxon_id"), ["name", "rank"], "left")
    return hit.groupBy("name", "rank").agg(F.coalesce(F.min("taxon_id"), F.lit(-1)).alias("taxon_id"))


def stage_status(stages: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Images, distinct observations and percentage of all images, for each stage."""
    n = stages.groupBy("stage").agg(F.count("*").alias("images"), F.countDistinct(ids.observation_id(F.col("img_id"))).alias("observations"))
    total = n.where("stage = 'image'").agg(F.max("images").alias("all"))
    return n.join(F.broadcast(total)).select("stage", "images", "observations", F.round(F.try_divide(F.col("images") * 100.0, F.col("all"))).alias("percent"))  # one row: a scalar


def trial_summary(trials: DataFrame) -> DataFrame:
    done = ~F.col("timed_out")
    found = F.coalesce(F.col("found"), F.lit(False)) & done
    return trials.groupBy("user_name").agg(
        F.count("*").alias("total"), F.sum(done.cast("long")).alias("completed"), F.sum(found.cast("long")).alias("found"),
        F.avg(F.when(found, F.col("reaction_time_seconds"))).alias("mean_reaction"), F.try_divide(F.sum(found.cast("double")), F.sum(done.cast("double"))).alias("accuracy"),
    )


def click_hits(trials: DataFrame) -> DataFrame:
    """Whether a click lies in the target's box, edges included."""
    inside = lambda c, m, s: F.abs(F.col(c) - F.col(m)) * 2 <= F.col(s)
    return trials.withColumn("hit", inside("click_x", "center_x", "width") & inside("click_y", "center_y", "height"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts."""
    c = confusion(predictions)
    rows = c.select(F.explode(F.array(F.struct(F.col("label").alias("k"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("predicted").alias("k"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("right")))).alias("e")).select("e.*")
    t = rows.groupBy("k").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("right").alias("right"))
    return t.select(F.col("k").alias("label"), F.try_divide("right", "claimed").alias("precision"), F.try_divide("right", "support").alias("recall"), F.try_divide(F.col("right") * 2.0, F.col("support") + F.col("claimed")).alias("f1"), "support")


def auroc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score, label 0/1) by ranks over distinct scores; ties count half."""
    n = scores.groupBy("score").agg(F.sum((F.col("label") == 1).cast("double")).alias("p"), F.sum((F.col("label") == 0).cast("double")).alias("n"))
    rows = ranges_in_order(n, ["score"], "place__").withColumn("part__", F.shiftright("place__", 33))
    w = Window.partitionBy("part__").orderBy("place__").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part__").agg(F.sum("n").alias("n__"))  # one row a range
    before = counts.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("b__"))
    total = F.sum(F.col("p") * (F.col("in__") + F.col("b__") + F.col("n") / 2))
    inside = rows.withColumn("in__", F.coalesce(F.sum("n").over(w), F.lit(0.0)))
    return inside.join(F.broadcast(before), "part__").agg(F.try_divide(total, F.sum("p") * F.sum("n")).alias("auroc"))
