"""Sources: pages, texts, entity lines, index tables, records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.register import decode_entities

ENTITY_SCHEMA = "file string, domain string, title string, author string, date string, description string, url string, tags array<string>"
PAGE_LOG_SCHEMA = "url string, status int, file string, length bigint, depth int, datetime string"
VOCAB_SCHEMA = "term string, df bigint, idf_ordinary double, idf_log double"
DOCS_SCHEMA = "doc_id bigint, site string, path string, length bigint"


def html_files(spark: SparkSession, root: str, decode: bool = False) -> DataFrame:
    """(path, size, html) of all ``*.html`` below ``root``; undecodable bytes become U+FFFD, with ``decode`` character references are decoded over the whole file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    html = F.try_validate_utf8(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", F.col("length").alias("size"), (decode_entities(html) if decode else html).alias("html"))


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, site, text) of all ``*.txt`` below ``root``; site is the folder, text is in lower case."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.input_file_name()
    return files.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("site"), F.lower("value").alias("text"))


def entity_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entities from JSON lines with a declared schema; malformed lines are dropped."""
    return spark.read.schema(ENTITY_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def last_per_file(entities: DataFrame, order: str) -> DataFrame:
    """The last entity of each file by ``order``; combined before the shuffle."""
    fields = [c for c in entities.columns if c not in ("file", order)]
    last = entities.groupBy("file").agg(F.max_by(F.struct(*fields), F.col(order)).alias("e"))
    return last.select("file", *[f"e.{c}" for c in fields])


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header, parted by tabs."""
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf) from the text form of posting lists."""
    t = tsv(spark, path, "term string, doc_freq bigint, postings string")
    one = t.select("term", F.explode(F.split("postings", ", ")).alias("p")).select("term", F.regexp_replace("p", r"[()]", "").alias("p"))
    return one.select("term", F.split_part("p", F.lit(":"), F.lit(1)).cast("bigint").alias("doc_id"), F.split_part("p", F.lit(":"), F.lit(2)).cast("double").alias("tf"))


def _rules_of(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, prefix) of the groups of a robots file that name the agent, of those for all agents if none does."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    fresh = True
    for line in text.splitlines():
        name, sign, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sign:
            continue
        if name == "user-agent":
            if fresh or not groups:
                groups.append(([], []))
                fresh = False
            groups[-1][0].append(value.lower())
        elif name in ("allow", "disallow") and groups:
            fresh = True
            if value:
                groups[-1][1].append((name == "allow", value))
    for wanted in (agent.lower(), "*"):
        found = [rules for agents, rules in groups if wanted in agents]
        if found:
            return [r for rules in found for r in rules]
    return []


def robots_rules(spark: SparkSession, root: str, agent: str = "*") -> DataFrame:
    """(host, prefix, allow) from ``<host>/robots.txt`` files: the rules for ``agent``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "robots.txt").text(root, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("host"), "value")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(h, p, a) for h, t in zip(pdf["host"], pdf["value"]) for a, p in _rules_of(t, agent)], columns=["host", "prefix", "allow"])

    return files.mapInPandas(run, "host string, prefix string, allow boolean").distinct()
