"""Record sources: CSV and TSV with explicit schemas, Darwin Core archives, codings, encodings, observation pages."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Columns are found by name, so files may hold more of them or another order."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def observation_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.INAT_RAW)


def unquoted_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text in which quotes are ordinary characters; only the wanted columns are kept."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]) if columns else df


def archive_member(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """A TSV member of zipped Darwin Core archives: each archive is one task, and its lines are streamed in batches."""
    import pandas as pd

    def run(batches):
        import io
        import zipfile

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    for part in pd.read_csv(f, sep="\t", quoting=3, dtype=str, keep_default_na=False, na_values=[""], chunksize=100_000):
                        yield part.reindex(columns=columns).astype(object).where(lambda d: d.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def archive_identifier(spark: SparkSession, path: str) -> DataFrame:
    """packageId of metadata.xml files."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.xpath_string("value", F.lit("/*/@packageId")).alias("package_id"))


def codings(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    return csv(spark, path, "id string, " + ", ".join(f"`{c}` string" for c in categories))


def encodings(spark: SparkSession, path: str, name: str = "image_name") -> DataFrame:
    """img_id and features; feature columns are those whose name holds a digit, in file order."""
    df = spark.read.option("header", True).csv(path)
    numbered = [c for c in df.columns if re.search(r"\d", c)]
    return df.select(F.regexp_replace(name, "[.]png$", "").alias("img_id"), F.array(*[F.expr(f"try_cast(`{c}` AS float)") for c in numbered]).alias("features"))


#: What is read of an observation page's JSON.
OBSERVATION = "struct<id:bigint,user:struct<id:bigint>,observed_on:string,location:string,taxon:struct<name:string>,license_code:string,photos:array<struct<url:string,original_dimensions:struct<width:int,height:int>>>,annotations:array<struct<controlled_attribute_id:int,controlled_value_id:int>>,tags:array<string>>"


def observations_of_pages(pages: DataFrame, column: str = "body") -> DataFrame:
    """Rows of raw observation pages ({"results": [...]}) in the downloader's shape; repeated observations count once."""
    o = F.from_json(F.col(column), f"results array<{OBSERVATION}>")
    each = pages.select(F.explode(o["results"]).alias("o")).select("o.*")
    place = F.split("location", ",")
    note = F.transform("annotations", lambda a: F.concat_ws(":", a["controlled_attribute_id"].cast("string"), a["controlled_value_id"].cast("string")))
    return each.select(
        F.col("id").alias("obs_id"), F.col("user.id").alias("usr_id"), F.col("observed_on").alias("date"),
        F.coalesce(F.get(place, F.lit(0)), F.lit("")).alias("latitude"), F.coalesce(F.get(place, F.lit(1)), F.lit("")).alias("longitude"),
        F.col("taxon.name").alias("taxon"), F.size("photos").alias("img_cnt"), F.replace(F.get(F.col("photos.url"), F.lit(0)), F.lit("/square."), F.lit("/medium.")).alias("img_url"),
        F.col("license_code").alias("license"), F.concat_ws(",", note).alias("annotations"), F.concat_ws(",", "tags").alias("tags"),
    ).dropDuplicates(["obs_id"])


def total_records(fetch, params: dict) -> int:
    """`total_results` of the service for some parameters, 0 on any error; `fetch(params) -> str` asks for a page."""
    try:
        return int(json.loads(fetch({**params, "page": 1, "per_page": 0}))["total_results"])
    except Exception:  # an unreachable service has no records to offer
        return 0


def observation_pages(spark: SparkSession, fetch, params: dict, per_page: int = 200, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """page, body, reason of all pages for some parameters, a page a row; a page is asked for up to `retries` times, `pause` seconds apart, and its error kept."""
    import pandas as pd

    pages = -(-total_records(fetch, params) // per_page)

    def run(batches):
        for pdf in batches:
            rows = []
            for page in pdf["page"]:
                body = reason = None
                for attempt in range(retries):
                    if attempt or rows:
                        time.sleep(pause)
                    try:
                        body, reason = fetch({**params, "page": int(page), "per_page": per_page}), None
                        break
                    except Exception as e:  # the reason is reported, not hidden
                        reason = f"{type(e).__name__}: {e}"[:200]
                rows.append((page, body, reason))
            yield pd.DataFrame(rows, columns=["page", "body", "reason"])

    return spark.range(1, pages + 1).select(F.col("id").alias("page")).mapInPandas(run, "page bigint, body string, reason string")


def split_intervals(count, start: datetime, stop: datetime, most: int = 4000) -> Iterator[tuple[datetime, datetime]]:
    """Creation-time intervals with at most `most` records each, by halving; `count(start, stop)` asks the service."""
    stack = [(start, stop)]
    while stack:
        a, z = stack.pop()
        if count(a, z) <= most or z - a <= timedelta(seconds=1):
            yield a, z
        else:
            middle = a + (z - a) / 2
            stack += [(middle, z), (a, middle)]


def download_requests(records: DataFrame) -> DataFrame:
    """(key, img_url) of every record with a link."""
    from ..functions import ids

    stem = F.regexp_replace(F.coalesce("file_name", F.lit("")), "[.][^.]*$", "")
    return records.where(F.col("img_url").isNotNull() & (F.col("img_url") != "")).select(ids.source_key(stem, F.col("img_url")).alias("key"), "img_url")


def downloaded(requests: DataFrame, fetch, threads: int = 20) -> DataFrame:
    """(key, img_url, ok, reason, content): `fetch(url) -> bytes` is run by `threads` threads a task; errors become rows."""
    import pandas as pd

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def one(url):
            try:
                data = fetch(url)
                return (True, None, data) if data else (False, "empty", None)
            except Exception as e:  # the reason is reported, not hidden
                return False, f"{type(e).__name__}: {e}"[:200], None

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                found = list(pool.map(one, pdf["img_url"]))
                yield pd.DataFrame({"key": pdf["key"], "img_url": pdf["img_url"], "ok": [f[0] for f in found], "reason": [f[1] for f in found], "content": [f[2] for f in found]})

    return requests.select("key", "img_url").mapInPandas(run, "key string, img_url string, ok boolean, reason string, content binary")
