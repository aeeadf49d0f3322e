"""Queries of this package; the entry module adds them if the package can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import boilerplate, bpe, language_id, leaks, linkage, markup, token_budget
from lexiloom.operators.index import corpus_totals
from lexiloom.runtime import table

WIKI = "wiki_kdrama_final1_parquet"
MARKUP_FIELDS = ("synopsis", "starring", "budget")


def p1_links(spark: SparkSession, root: str) -> DataFrame:
    """The record of the show each page is about, with a confidence."""
    return linkage.link(table(spark, root, "entities"), table(spark, root, WIKI), table(spark, root, "sites"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages about exactly one show with the wiki_id of the show."""
    return p1_links(spark, root).select("entity_id", "wiki_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The sorts of markup elements in each text of a record."""
    return markup.elements(table(spark, root, WIKI), "rec_id", MARKUP_FIELDS)


def p4_clean(spark: SparkSession, root: str) -> DataFrame:
    """Clean texts with headings, lists, code and formulas still told apart."""
    long = table(spark, root, WIKI).select("rec_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in MARKUP_FIELDS])).alias("f"))
    return long.where(F.col("f.raw").rlike(r"\S")).select("rec_id", "f.field", markup.clean(F.col("f.raw")).alias("text"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of page texts that are not part of the article."""
    return boilerplate.frame_lines(table(spark, root, "data_extracted"))


def _document_tokens(spark: SparkSession, root: str) -> DataFrame:
    return token_budget.document_tokens(table(spark, root, "documents"), table(spark, root, "docs"), table(spark, root, "sites"))


def p6_totals(spark: SparkSession, root: str) -> DataFrame:
    """Token totals per site, language and source."""
    return token_budget.totals(_document_tokens(spark, root))


def p6_documents(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each document with its site, language and source."""
    return _document_tokens(spark, root)


def p6_globals(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the corpus: documents, words, sites and vocabulary, and its tokens under the public tokenizer."""
    tokens = _document_tokens(spark, root).agg(F.lit("tokens").alias("name"), F.sum("tokens").alias("value"))
    return corpus_totals(table(spark, root, "documents")).unionByName(tokens)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, root, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Documents that carry evaluation passages, with matched words and edits."""
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Which documents carry which evaluation items."""
    return p9_leaks(spark, root).select("doc_id", "item_id").distinct()


def p10_segments(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    documents = table(spark, root, "documents")
    return language_id.segments(documents, language_id.train(documents))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Segments of documents whose label is missing, says nothing or is wrong, and of mixed documents."""
    rows = p10_segments(spark, root).where("label is null or n_segments > 1 or label <> lang")
    return rows.select("doc_id", "seg", "lang").distinct()


def queries() -> dict:
    return {"p1_found": p1_found, "p1_links": p1_links, "p4_found": p4_found, "p4_clean": p4_clean, "p5_found": p5_found, "p6_totals": p6_totals, "p6_documents": p6_documents, "p6_globals": p6_globals, "p8_ids": p8_ids,
            "p9_found": p9_found, "p9_leaks": p9_leaks,
            "p10_found": p10_found, "p10_segments": p10_segments}


def oracle_sql() -> dict[str, str]:
    return {}
