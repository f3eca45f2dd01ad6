"""A project: named tables below one base path, and what is done to them as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids
from ..operators import records as R
from ..storage import written
from . import images


class Project:
    """records, metrics, codings, failed, balanced and downloads are Parquet tables; images are blobs by stage."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def create(self) -> Project:
        """Empty tables, where there are none."""
        for name, schema in (("records", schemas.RECORDS), ("failed", "img_id string"), ("codings", schemas.CODINGS), ("downloads", schemas.DOWNLOADS)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))
        self.spark.createDataFrame([], schemas.BLOBS).write.mode("ignore").partitionBy("stage").parquet(self.path("blobs"))
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Written beside the old table first, as the new rows may be read from it."""
        rows.write.mode("overwrite").parquet(self.path(f"_{name}_new"))
        self.spark.read.parquet(self.path(f"_{name}_new")).write.mode("overwrite").parquet(self.path(name))

    def stages(self) -> DataFrame:
        return images.blob_ids(self.spark.read.schema(schemas.BLOBS).parquet(self.path("blobs")))

    def status(self) -> DataFrame:
        return R.stage_status(self.stages())

    def ids_to_mask(self) -> DataFrame:
        at = self.stages()
        return R.to_mask(at.where("stage = 'image'"), at.where("stage = 'mask'"), self.table("failed"))

    def delete(self, img_ids: DataFrame, stage: str) -> DataFrame:
        """Removes ids of a stage; returns img_id and whether it was there."""
        there = self.stages().where(F.col("stage") == stage).select("img_id", F.lit(True).alias("deleted")).distinct()
        report = img_ids.select("img_id").distinct().join(there, "img_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        report = written(report)  # before the blobs go
        kept = self.spark.read.schema(schemas.BLOBS).parquet(self.path("blobs"))
        gone = img_ids.select(ids.image_file(F.col("img_id"), stage).alias("name"))
        self.replace_blobs(kept.join(gone, "name", "left_anti"))
        return report

    def replace_blobs(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("stage").parquet(self.path("_blobs_new"))
        self.spark.read.schema(schemas.BLOBS).parquet(self.path("_blobs_new")).write.mode("overwrite").partitionBy("stage").parquet(self.path("blobs"))

    def copy(self, img_ids: DataFrame, stage: str, out: str) -> None:
        names = img_ids.select(ids.image_file(F.col("img_id"), stage).alias("name"))
        images.write_blobs(R.existing(self.spark.read.schema(schemas.BLOBS).parquet(self.path("blobs")), names, "name"), out)

    def note_failed(self, img_ids: DataFrame) -> None:
        self.replace("failed", R.united_ids(self.table("failed"), img_ids))

    def code(self, new: DataFrame, categories: list[str]) -> None:
        self.replace("codings", R.merged_codings(self.table("codings"), new, categories))

    def balanced_ids(self, group: str, n: int, seed: int = 1) -> DataFrame:
        return R.sample_per_group(self.table("records"), group, n, "img_id", seed).select("img_id")


def write_chunks(df: DataFrame, order: list[str], size: int, path: str) -> None:
    """Chunks of at most `size` rows in folders chunk=0, 1, ..; a finished folder may be deleted and the rest resumed."""
    R.chunked(df, order, size).write.mode("overwrite").option("header", True).partitionBy("chunk").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def merged_csvs(spark: SparkSession, folder: str, schema) -> DataFrame:
    from .records import csv

    return csv(spark, folder, schema)


def write_ids(img_ids: DataFrame, path: str) -> None:
    img_ids.select(F.col("img_id").cast("string")).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("img_id"))


def training_set(records: DataFrame, group: str, most: int, least: int) -> tuple[DataFrame, dict]:
    """Rows of a training folder (first `most` of each class with at least `least`), and its settings with the class count."""
    rows = R.first_n_per_group(records, group, most, least, "img_id")
    return rows, {"classes": rows.select(group).distinct().count(), "max_per_class": most, "min_per_class": least}


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def clear_folder(spark: SparkSession, path: str, confirmed: bool = False) -> int:
    """Deletes all in a folder but the folder itself; returns the number of its entries.  Nothing happens unless confirmed."""
    if not confirmed:
        return 0
    fs, p = _folder(spark, path)
    entries = [s.getPath() for s in fs.listStatus(p)]
    for e in entries:
        fs.delete(e, True)
    return len(entries)


def zip_folder(spark: SparkSession, path: str, out: str) -> int:
    """Zips the files below a folder under their relative names, one after another, into a local file; returns their number."""
    import zipfile

    fs, p = _folder(spark, path)
    base, n = fs.getFileStatus(p).getPath().toString().rstrip("/") + "/", 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.toLocalIterator():
            z.writestr(r.path.removeprefix(base), bytes(r.content))
            n += 1
    return n


def write_exemplars(images: DataFrame, choices: DataFrame, path: str) -> None:
    """taxon, exemplar_img_id of each choice (taxon, ordinal) as CSV."""
    write_csv(R.chosen_exemplars(images, choices), path)
