"""Incremental ingestion: an extension for runs that may be interrupted and repeated.

Files that appear in a folder are read once, observations are taken once, and
what a target table already has is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import INAT_RAW


def arriving(spark: SparkSession, folder: str, schema=INAT_RAW, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", max_files).csv(folder)


def take_new(stream: DataFrame, target: str, checkpoint: str, key: str = "obs_id", once: bool = True) -> StreamingQuery:
    """Appends rows whose key the target does not have yet.  A repeated batch adds nothing, so delivery is effectively once."""

    def sink(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            old = batch.sparkSession.read.parquet(target).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(old, key, "left_anti")
        new.write.mode("append").parquet(target)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(stream: DataFrame, time: str, group: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts a window and group; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n")).select("w.start", group, "n")
