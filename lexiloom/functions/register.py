"""SQL functions of this package."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """All HTML 5 references decoded; null stays null."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def register(spark: SparkSession) -> None:
    """Register ``decode_entities``, ``strip_html`` and the table function ``tfidf_search(words, k)`` for SQL.

    ``tfidf_search`` reads the view ``tfidf_counts`` (doc_id, term, n), as ``index.term_counts`` gives it.
    """
    spark.udf.register("decode_entities", decode_entities)
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION strip_html(t STRING) RETURNS STRING
        RETURN trim(regexp_replace(regexp_replace(regexp_replace(t, r'(?is)<(script|style)\b[^>]*>.*?</\1\s*>', ' '), r'(?s)<!--.*?-->|<[^>]+>', ' '), r'\s+', ' '))""")
    if spark.catalog.tableExists("tfidf_counts"):
        spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION tfidf_search(asked STRING, k INT) RETURNS TABLE(doc_id BIGINT, score DOUBLE, place INT)
            RETURN WITH terms AS (SELECT term, count(*) AS times FROM (SELECT explode(split(lower(asked), ' ')) AS term) WHERE term <> '' GROUP BY term),
                hit AS (SELECT c.doc_id, c.term, round(1 + ln(c.n), 6) AS tf, times FROM tfidf_counts c JOIN terms USING (term)),
                idf AS (SELECT term, round(ln(1 + (SELECT count(DISTINCT doc_id) FROM tfidf_counts) / count(*)), 6) AS idf FROM hit GROUP BY term),
                scored AS (SELECT doc_id, round(sum(tf * idf * times), 6) AS score FROM hit JOIN idf USING (term) GROUP BY doc_id)
            SELECT doc_id, score, place FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS place FROM scored) WHERE place <= k""")
