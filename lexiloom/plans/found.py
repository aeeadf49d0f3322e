"""Queries of the general data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.domains import site_key
from lexiloom.operators.packed import unpack
from lexiloom.operators.timestamps import normalise, zone_intervals
from lexiloom.operators.units import budgets, durations
from lexiloom.runtime import table

WIKI = "wiki_kdrama_final1_parquet"
#: Currency of budgets that name none: the records are of South Korean series.
BUDGET_CURRENCY = "KRW"


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """One row for each name in alt_name, starring and genre."""
    return unpack(table(spark, root, WIKI), "rec_id", ("alt_name", "starring", "genre"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Budgets in won and runtimes in seconds."""
    wiki = table(spark, root, WIKI)
    return budgets(wiki, "rec_id", "budget", table(spark, root, "fx_rates"), BUDGET_CURRENCY).unionByName(durations(wiki, "rec_id", "runtime"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Every stated date of pages and records in one normal form."""
    sites = table(spark, root, "sites").select(site_key(F.col("domain")).alias("_site"), F.col("time_zone").alias("zone"), "date_order").dropDuplicates(["_site"])
    pages = table(spark, root, "entities").select(
        F.lit("entities").alias("tab"), F.col("entity_id").alias("row_id"), F.lit("date").alias("field"), F.col("date").alias("text"),
        F.coalesce(site_key(F.col("domain")), site_key(F.col("url")), F.split_part("file", F.lit("_"), F.lit(1))).alias("_site"))
    wiki = table(spark, root, WIKI)
    records = wiki.select("rec_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("first_aired", "last_aired")])).alias("f")).select(
        F.lit(WIKI).alias("tab"), F.col("rec_id").alias("row_id"), "f.field", "f.text", F.lit(None).cast("string").alias("_site"))
    texts = pages.unionByName(records).where(F.col("text").rlike(r"\d{4}")).join(sites, "_site", "left")
    return normalise(texts, zone_intervals(sites)).where("norm is not null").select("tab", "row_id", "field", "norm")


def queries() -> dict:
    return {"p2_found": p2_found, "p3_found": p3_found, "p7_found": p7_found}
