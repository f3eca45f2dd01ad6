"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds at a time (one longer text is held alone).
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo `modulus`; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; set a local one only where it is unset."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(there or f"/tmp/checkpoints/{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose summed lengths stay within `limit`, a longer row alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Byte length of each value of a string or binary array, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold a bounded amount of text."""
    for i, j in slices(byte_lengths(batch.column(text)), limit):
        yield batch.slice(i, j - i)


#: Maps A-Z to a-z and every ASCII byte but digits and letters to a space; other bytes stay.
ALNUM_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after lower-casing A-Z."""
    return text.translate(ALNUM_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text after lower-casing A-Z."""
    return text.lower().split()


#: Bytes of an Arrow batch: a task holds a few at a time, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most BATCH_BYTES (or one row); a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, str(1 << 30)))
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def doc_view(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The columns that a kernel reads, under fixed names: id, text as UTF-8 bytes, and any more."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Paths written since each last_written() of this thread began.
_open = threading.local()


def _begun() -> list[list[str]]:
    if not hasattr(_open, "paths"):
        _open.paths = []
    return _open.paths


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared checkpoint folder (smaller there than checkpoint())."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if _begun():
        _begun()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def last_written(spark: SparkSession, make) -> DataFrame:
    """A table made by `make()`, written; all tables written on the way are deleted."""
    _begun().append([])
    try:
        out = make()
        inside = _begun().pop()
    except BaseException:
        discard(spark, _begun().pop())
        raise
    kept = written(out)
    discard(spark, inside)
    return kept


#: Rows (a key of up to 20 bytes and a few numbers each) up to which a side of a join is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def beside(rows: DataFrame, count: int) -> DataFrame:
    """Rows of at most `count` as a side of a join: broadcast where these are few."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


SPANS = "array<struct<start:bigint,stop:bigint>>"


def united(spans: str) -> Column:
    """Maximal ranges of an array of (start, stop) that may overlap or touch, ascending."""
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort(spans),
        F.expr(f"cast(array() as {SPANS})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["stop"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def joined_texts(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes], bytes, np.ndarray]]:
    """(rows, texts, all texts in one buffer, their starts and the end) of bounded slices."""
    for batch in batches:
        for b in chunks(batch, text, limit):
            texts = [x or b"" for x in b.column(text).to_pylist()]
            starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
            yield b, texts, b"".join(texts), starts
