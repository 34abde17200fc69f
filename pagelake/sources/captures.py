"""Captured responses and seed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.schemas import CAPTURE, REQUEST


def read_captures(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A1: the capture table at ``path``, one row per fetched response."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(CAPTURE).parquet(path)


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """A1: ``pages(url, html)`` as captures: status 200, UTF-8, no headers."""
    return pages.select(
        "url",
        F.lit(200).alias("status"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit("utf-8").alias("encoding"),
        F.encode("html", "UTF-8").alias("body"),
        F.array().cast("array<string>").alias("flags"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def seeds(spark: SparkSession, urls: list[str] | DataFrame) -> DataFrame:
    """A2: start requests of a list or a table of URLs; they pass the duplicate test."""
    if not isinstance(urls, DataFrame):
        urls = spark.createDataFrame([(u,) for u in urls], "url string")
    values = {
        "seq": F.monotonically_increasing_id(),
        "url": F.col("url"),
        "method": F.lit("GET"),
        "body": F.lit(None),
        "kind": F.lit("list"),
        "priority": F.lit(0),
        "dont_filter": F.lit(True),
        "depth": F.lit(0),
    }
    return urls.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in REQUEST])
