"""Inverted index with TF-IDF weights and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.runtime import cut


def words(text: Column) -> Column:
    """Words of a text in lower case, parted by blanks only; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, n): occurrences of each term in each document, combined before the shuffle."""
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def weights(counts: DataFrame) -> DataFrame:
    """Add ``tf`` = 1 + ln n, rounded to six places."""
    return counts.withColumn("tf", F.round(1 + F.log("n"), 6))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, df, idf_ordinary, idf_log) over the documents that hold a term."""
    n = counts.agg(F.countDistinct("doc_id").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    x = df.join(F.broadcast(n))  # one row
    return x.select("term", "df", F.round(F.log(F.col("n_docs") / F.col("df")), 6).alias("idf_ordinary"), F.round(F.log(1 + F.col("n_docs") / F.col("df")), 6).alias("idf_log"))


def postings_blocks(counts: DataFrame, size: int = 4096) -> DataFrame:
    """(term, block, ids, tfs): postings of ``size`` neighbouring documents a row, so that no cell grows with the corpus."""
    one = weights(counts).groupBy("term", F.floor(F.col("doc_id") / size).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    return one.select("term", "block", F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("tfs"))


def postings(counts: DataFrame) -> DataFrame:
    """(term, doc_freq, postings): ``(doc:tf), ...`` in document order, the text form for export; searches read blocks or counts."""
    blocks = postings_blocks(counts)
    text = F.array_join(F.transform(F.arrays_zip("ids", "tfs"), lambda x: F.concat(F.lit("("), x["ids"].cast("string"), F.lit(":"), F.format_string("%.6f", x["tfs"]), F.lit(")"))), ", ")
    parts = blocks.select("term", F.size("ids").alias("n"), F.struct("block", text.alias("text")).alias("part"))
    lists = parts.groupBy("term").agg(F.sum("n").alias("doc_freq"), F.array_sort(F.collect_list("part")).alias("parts"))
    return lists.select("term", "doc_freq", F.array_join("parts.text", ", ").alias("postings"))


def corpus_totals(docs: DataFrame, site: str = "source") -> DataFrame:
    """(name, value): documents with words, words, vocabulary and sites."""
    w = docs.select(F.col(site).alias("site"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    one = w.agg(F.count("*").alias("documents"), F.sum(F.size("w")).alias("words"), F.countDistinct("site").alias("sites"))
    vocab = w.select(F.explode("w").alias("term")).agg(F.countDistinct("term").alias("vocabulary"))
    return one.join(F.broadcast(vocab)).unpivot([], ["documents", "words", "sites", "vocabulary"], "name", "value").select("name", F.col("value").cast("bigint").alias("value"))


def _asked_vocabulary(docs: DataFrame, counts: DataFrame, key: str, text: str) -> DataFrame:
    """Vocabulary of counts that hold only the asked terms; the number of documents comes from a scan without words."""
    n = docs.where(F.coalesce(F.col(text), F.lit("")).rlike("[^ ]")).agg(F.countDistinct(key).alias("n_docs"))
    x = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))  # one row
    return x.select("term", F.round(F.log(F.col("n_docs") / F.col("df")), 6).alias("idf_ordinary"), F.round(F.log(1 + F.col("n_docs") / F.col("df")), 6).alias("idf_log"))


def search(docs: DataFrame, query: list[str], idf: str = "idf_log", k: int = 5, stop_words: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top ``k`` (doc_id, score) of a query's terms; a repeated term counts again, ties go to the smaller id.

    Only the asked terms are counted and shuffled. A query of stop words finds nothing.
    """
    spark = docs.sparkSession
    asked = [t for t in query if t not in stop_words]
    terms = spark.createDataFrame([(t, asked.count(t)) for t in sorted(set(asked))], "term string, times int")
    found = docs.select(F.col(key).alias("doc_id"), F.explode(F.filter(words(F.col(text)), lambda w: w.isin(*set(asked)) if asked else F.lit(False))).alias("term"))
    counts = found.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    hit = weights(counts).join(F.broadcast(terms), "term").join(_asked_vocabulary(docs, counts, key, text), "term")
    return hit.groupBy("doc_id").agg(F.round(F.sum(F.col("tf") * F.col(idf) * F.col("times")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def search_batch(docs: DataFrame, queries: DataFrame, idf: str = "idf_log", k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): top ``k`` documents of each query (item_id, terms).

    Words that no query asks for are dropped before they are counted. A common term meets many queries:
    scores are summed per query and document before any rank, and the rank keeps ``k`` rows a task first.
    """
    terms = queries.select("item_id", F.explode("terms").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    found = docs.select(F.col(key).alias("doc_id"), F.explode(words(F.col(text))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    counts = found.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    hit = weights(counts).join(_asked_vocabulary(docs, counts, key, text), "term").join(terms, "term")
    score = hit.groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("tf") * F.col(idf) * F.col("times")), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _field_words(f: str, exact: tuple[str, ...]) -> Column:
    text = F.coalesce(F.col(f), F.lit(""))
    return F.array(text) if f in exact else F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")


def field_terms(records: DataFrame, key: str, fields: tuple[str, ...], exact: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, term, n, len): terms of analysed fields and whole values of exact ones."""
    long = records.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.filter(_field_words(f, exact), lambda w: w != "").alias("terms")) for f in (*fields, *exact)])).alias("x"))
    return long.select(key, F.col("x.field").alias("field"), F.size("x.terms").alias("len"), F.explode("x.terms").alias("term")).groupBy(key, "field", "term", "len").agg(F.count("*").alias("n"))


def field_parts(fields: tuple[str, ...], exact: tuple[str, ...] = (), query: tuple[str, ...] = ()) -> Column:
    """Array of (field, len, asked) over the fields with terms: their number, and the terms the query asks for as often as they occur."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.filter(_field_words(f, exact), lambda w: w != "").alias("terms")) for f in (*fields, *exact)])
    asked = lambda terms: F.filter(terms, lambda w: w.isin(*set(query))) if query else F.array().cast("array<string>")
    return F.filter(F.transform(each, lambda x: F.struct(x["field"].alias("field"), F.size(x["terms"]).alias("len"), asked(x["terms"]).alias("asked"))), lambda x: x["len"] > 0)


def parts_statistics(parts: DataFrame) -> DataFrame:
    """(field, docs, avg_len) of (key, field, len), one row for each key and field with terms."""
    return parts.groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))


def search_parts(parts: DataFrame, key: str, query: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``search_fields`` over (key, field, len, asked) of ``field_parts``, one row for each key and field; terms that no query asks for are never written out."""
    x = cut(parts)
    asked = x.sparkSession.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "term string, times int")
    hit = x.select(key, "field", "len", F.explode("asked").alias("term")).groupBy(key, "field", "term", "len").agg(F.count("*").alias("n"))
    return _bm25(hit.join(F.broadcast(asked), "term"), parts_statistics(x), key, k, k1, b)


def search_fields(terms: DataFrame, key: str, query: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` (key, score): sum over fields and query terms of BM25 with statistics per field."""
    spark = terms.sparkSession
    asked = spark.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "term string, times int")
    stats = terms.groupBy("field", key, "len").agg(F.lit(1)).groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    return _bm25(terms.where(F.col("term").isin(*set(query))).join(F.broadcast(asked), "term"), stats, key, k, k1, b)


def _bm25(hit: DataFrame, stats: DataFrame, key: str, k: int, k1: float, b: float) -> DataFrame:
    df = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    x = hit.join(df, ["field", "term"]).join(stats, "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") / (F.col("n") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) * F.col("times")
    return x.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def store_fields(records: DataFrame, key: str, path: str, fields: tuple[str, ...], exact: tuple[str, ...] = (), stored: tuple[str, ...] = ()) -> None:
    """Write the index of ``records`` below ``path``: ``field_tokens``, ``field_stats`` and ``stored``.

    Tokens lie in one folder per bucket of terms, sorted by term, so a search reads the buckets of its
    terms and of those the row groups that hold them. ``stored`` has every field as it was, one row a record.
    """
    terms = field_terms(records, key, fields, exact).withColumn("bucket", _bucket(F.col("term")))
    terms.repartition("bucket", (F.xxhash64(key) % 8)).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/field_tokens")
    tokens = records.sparkSession.read.parquet(f"{path}/field_tokens")
    stats = tokens.groupBy("field", key, "len").agg(F.lit(1)).groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    stats.write.mode("overwrite").parquet(f"{path}/field_stats")
    records.select(key, *[F.col(c) for c in dict.fromkeys((*fields, *exact, *stored)) if c != key]).write.mode("overwrite").parquet(f"{path}/stored")


def search_index(spark: SparkSession, path: str, key: str, query: list[str], k: int = 10, fields: tuple[str, ...] = (), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` (key, score) of an index that ``store_fields`` wrote, read without the records; ``fields`` bounds the searched ones."""
    asked = spark.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "term string, times int")
    buckets = [r["bucket"] for r in asked.select(_bucket(F.col("term")).alias("bucket")).distinct().collect()]  # one a query term
    hit = spark.read.parquet(f"{path}/field_tokens").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*set(query)))
    hit = (hit.where(F.col("field").isin(*fields)) if fields else hit).join(F.broadcast(asked), "term")
    return _bm25(hit, spark.read.parquet(f"{path}/field_stats"), key, k, k1, b)


def stored_rows(spark: SparkSession, path: str, hits: DataFrame, key: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, field, value) of hits: the stored fields that are neither hidden nor blank."""
    docs = spark.read.parquet(f"{path}/stored")
    shown = [c for c in docs.columns if c != key and c not in hidden]
    rows = docs.join(F.broadcast(hits), key)  # hits are at most k
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in shown])
    return rows.select(key, "score", F.explode(F.filter(pairs, lambda x: F.trim(x["value"]) != "")).alias("x")).select(key, "score", "x.field", "x.value")
