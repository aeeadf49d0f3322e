"""The page pipeline over a stream of entity lines or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.normalise import page_title
from lexiloom.operators.pages import attributes
from lexiloom.sources.readers import ENTITY_SCHEMA


def entity_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entities from JSON lines files as they arrive."""
    return spark.readStream.schema(ENTITY_SCHEMA).json(path)


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Attributes of pages (url, html) from parquet files as they arrive; stateless."""
    pages = spark.readStream.schema("url string, html string").parquet(path)
    return pages.select("url", *[c.alias(f"page_{n}") for n, c in attributes(F.col("html")).items()])


def fetch_counts(log: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Fetches per window and status of a stream of page log rows (ts, status); rows later than ``late`` are dropped by the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("fetches"))


def titles(entities: DataFrame) -> DataFrame:
    """Normal titles of streamed entities."""
    return entities.select("file", page_title(F.col("title")).alias("title_clean"))
