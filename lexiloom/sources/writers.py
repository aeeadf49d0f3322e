"""Sinks. Every write overwrites, so a rerun leaves no repeats, and none gathers its rows in one task unless one file is the format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages(df: DataFrame, path: str) -> None:
    """Pages with a domain column, one folder per domain; busy domains spread over several files."""
    df.repartition("domain", (F.xxhash64("url") % 16)).write.mode("overwrite").partitionBy("domain").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Page log rows added to what is there; the fetch time is a column, not the clock."""
    df.write.mode("append").option("sep", "\t").option("header", "true").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept out."""
    df.write.mode("overwrite").json(path)


def tsv(df: DataFrame, path: str, order: str) -> None:
    """A table with a header parted by tabs, in the order of a column over all part files."""
    df.orderBy(order).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").option("escape", "").csv(path)


def texts(df: DataFrame, path: str) -> None:
    """One text a line."""
    df.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def parquet(df: DataFrame, path: str) -> None:
    """Parquet, in as many files as the plan has partitions."""
    df.write.mode("overwrite").parquet(path)


def index_table(df: DataFrame, name: str, buckets: int = 64) -> None:
    """A table in buckets of terms, sorted, so a query reads only its terms' buckets and row groups."""
    df.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)
