"""Image sources and sinks: files, key-value blobs and the pixel relation."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """img_id, stage, width, height, n_channels and data (BGR or BGRA rows) of decodable images below a path."""
    i = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select("image.*")
    name = ids.file_name(F.col("origin"))
    return i.select(ids.image_id(name).alias("img_id"), ids.stage_of(name).alias("stage"), "width", "height", F.col("nChannels").alias("n_channels"), "data")


def image_names(spark: SparkSession, path: str, endings: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """path and name of image files, without reading them; ordered regardless of case by whoever needs it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select("path", ids.file_name(F.col("path")).alias("name")).where(F.lower(F.element_at(F.split("name", "[.]"), -1)).isin(*endings))


def ids_in_folder(spark: SparkSession, path: str) -> DataFrame:
    return image_names(spark, path).select(ids.image_id(F.col("name")).alias("img_id"), ids.stage_of(F.col("name")).alias("stage"))


#: Pixels of an image that are given out at a time.
PIXELS = 1 << 18


def pixels(images: DataFrame) -> DataFrame:
    """The pixel relation of image rows.  Nothing is shuffled: each image is taken apart where it was read."""
    import numpy as np
    import pyarrow as pa

    names = ("img_id", "y", "x", "r", "g", "b", "alpha")

    def run(batches):
        for batch in batches:
            for img_id, w, h, c, data in zip(*(batch.column(n).to_pylist() for n in ("img_id", "width", "height", "n_channels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8, w * h * c).reshape(h * w, c).astype(np.int32)
                a = np.repeat(a, 3, axis=1) if c == 1 else a[:, [2, 1, 0, *range(3, c)]]
                for i in range(0, h * w, PIXELS):
                    part = a[i : i + PIXELS]
                    y, x = np.divmod(np.arange(i, i + len(part), dtype=np.int32), np.int32(w))
                    alpha = pa.array(part[:, 3]) if c == 4 else pa.nulls(len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([img_id] * len(part), pa.string()), pa.array(y), pa.array(x), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(3)), alpha], names)

    return images.select("img_id", "width", "height", "n_channels", "data").mapInArrow(run, "img_id string, y int, x int, r int, g int, b int, alpha int")


def png(width: int, height: int, rows: bytes, channels: int) -> bytes:
    """A PNG file of 8-bit gray (1), RGB (3) or RGBA (4) rows."""
    kind = {1: 0, 3: 2, 4: 6}[channels]
    line = width * channels
    raw = b"".join(b"\0" + rows[i * line : (i + 1) * line] for i in range(height))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def encoded(px: DataFrame, stage: str) -> DataFrame:
    """(name, stage, content): a PNG of each image of a pixel relation (r, g, b and, if there, alpha)."""
    import numpy as np
    import pandas as pd

    columns = ["r", "g", "b", *(["alpha"] if "alpha" in px.columns else [])]

    def run(pdf):
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        a = np.zeros((h, w, len(columns)), np.uint8)
        a[pdf["y"], pdf["x"]] = pdf[columns].to_numpy()
        return pd.DataFrame({"img_id": [str(pdf["img_id"].iloc[0])], "content": [png(w, h, a.tobytes(), len(columns))]})

    made = px.select("img_id", "y", "x", *columns).groupBy("img_id").applyInPandas(run, "img_id string, content binary")
    return made.select(ids.image_file(F.col("img_id"), stage).alias("name"), F.lit(stage).alias("stage"), "content")


def write_blobs(blobs: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by stage.  The stage is the one the name says where the column is missing."""
    out = blobs if "stage" in blobs.columns else blobs.withColumn("stage", ids.stage_of(F.col("name")))
    out.write.mode(mode).partitionBy("stage").parquet(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def blob_ids(store: DataFrame, stage: str | None = None) -> DataFrame:
    """Ids of stored names, without reading contents."""
    names = store.select("name", "stage") if stage is None else store.where(F.col("stage") == stage).select("name", "stage")
    return names.select(ids.image_id(F.col("name")).alias("img_id"), "stage")


def blobs_in_order(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """(pos, name, content) of wanted names; null where missing."""
    return wanted.join(store.select("name", "content"), "name", "left").select("pos", "name", "content")


def folder_to_blobs(spark: SparkSession, path: str, out: str) -> None:
    """Image files of a project folder into the store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    write_blobs(files.select(ids.file_name(F.col("path")).alias("name"), "content"), out)


def camera_models(files: DataFrame) -> DataFrame:
    """(name, model) from EXIF blocks of (name, content) JPEG rows."""
    import pandas as pd

    def model(content: bytes) -> str | None:
        start = content.find(b"Exif\0\0")
        if start < 0:
            return None
        t = content[start + 6 :]
        order = "<" if t[:2] == b"II" else ">"
        try:
            at = struct.unpack_from(order + "I", t, 4)[0]
            for i in range(struct.unpack_from(order + "H", t, at)[0]):
                tag, kind, n, value = struct.unpack_from(order + "HHII", t, at + 2 + 12 * i)
                if tag == 0x0110 and kind == 2:
                    where = value if n > 4 else at + 2 + 12 * i + 8
                    return t[where : where + n].split(b"\0")[0].decode("ascii", "replace").strip()
        except struct.error:
            return None
        return None

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "model": [model(c or b"") for c in pdf["content"]]})

    return files.select("name", "content").mapInPandas(run, "name string, model string")


def tiff(content: bytes):
    """(h, w, channels) array of the first image of a TIFF of 8-bit samples, plain or deflated."""
    import numpy as np

    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if size:
            start = at + 10 + 12 * k if size * n <= 4 else struct.unpack(order + "I", content[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = struct.unpack(f"{order}{n}{code}", content[start : start + size * n])
    # Tag numbers of width, height, bits, compression, strips' places, samples, strips' sizes, planes.
    w, h, c = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    if set(tags.get(258, (1,))) != {8} or tags.get(259, (1,))[0] not in (1, 8, 32946) or tags.get(284, (1,))[0] != 1:
        raise ValueError("only 8-bit samples in one plane, plain or deflated, are read")
    strips = [content[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    data = b"".join(s if tags.get(259, (1,))[0] == 1 else zlib.decompress(s) for s in strips)
    return np.frombuffer(data, np.uint8, h * w * c).reshape(h, w, c)


def tiffs_to_png(files: DataFrame, factor: int) -> DataFrame:
    """name, data of TIFF files (path, content) as PNG, each `factor` x `factor` pixels averaged to one; what is no such TIFF goes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names, out = [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    a = tiff(content)
                except (ValueError, KeyError, struct.error, zlib.error):
                    continue
                h, w = a.shape[0] // factor, a.shape[1] // factor
                if not h or not w:
                    continue
                small = a[: h * factor, : w * factor].reshape(h, factor, w, factor, -1).mean(axis=(1, 3)).round().astype("uint8")
                names.append(path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".png")
                out.append(png(w, h, small.tobytes(), small.shape[2]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["name", "data"])

    return files.select("path", "content").mapInArrow(run, "name string, data binary")
