"""Image, observation and file identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_id(name: Column) -> Column:
    """Drops every `.jpg` and `.png`, then a last `_` part."""
    return F.regexp_replace(F.replace(F.replace(name, F.lit(".jpg"), F.lit("")), F.lit(".png"), F.lit("")), "_[^_]*$", "")


def observation_id(img_id: Column) -> Column:
    """Drops the last `-` part; empty where there is none."""
    return F.when(F.instr(img_id, "-") > 0, F.regexp_replace(img_id, "-[^-]*$", "")).otherwise(F.when(img_id.isNotNull(), F.lit("")))


def metric_observation_id(img_id: Column) -> Column:
    """Drops a final `-1` only."""
    return F.regexp_replace(img_id, "-1$", "")


def record_id(img_id: Column) -> Column:
    return F.substring_index(img_id, "-", 2)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def image_file(img_id: Column, stage: str) -> Column:
    """File endings of the stages."""
    return F.concat(img_id, F.lit({"image": ".jpg", "mask": "_mask.png", "segment": "_segment.png", "pattern": "_pattern.png"}[stage]))


def stage_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("_segment")), "segment").when(F.contains(name, F.lit("_mask")), "mask").when(F.contains(name, F.lit("_pattern")), "pattern").otherwise("image")


def source_key(stem: Column, url: Column) -> Column:
    """INAT- and the file's stem, or OBS- and the last part of the link where there is no stem."""
    return F.when(F.coalesce(stem, F.lit("")) != "", F.concat(F.lit("INAT-"), stem)).otherwise(F.concat(F.lit("OBS-"), F.substring_index(url, "/", -1)))


def genus_of(species: Column) -> Column:
    return F.substring_index(species, " ", 1)


def sized_url(url: Column, size: str) -> Column:
    return F.replace(F.replace(url, F.lit("/square."), F.lit(f"/{size}.")), F.lit("original"), F.lit(size))


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
