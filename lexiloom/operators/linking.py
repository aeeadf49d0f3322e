"""Linking of pages to records by tag, title phrase and alternative name, longest match first.

Phrase containment is an equi-join: the distinct word n-grams of a title, up to the longest name,
meet the names. It runs once per title and name, however many pages and records bear them: what keeps
one match takes the least page and record of each, only a list of all matches multiplies them out.
Match keys are narrow; ``attach`` puts the attributes of page and record back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.normalise import flatten_text, name_list, page_title, record_title

PRIORITY = {"title": 0, "alt": 1, "tag": 2}


def ngrams(text: Column, most: int) -> Column:
    """Distinct runs of 1 to ``most`` words."""
    w = F.filter(F.split(text, " "), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(most), F.greatest(F.size(w) - i + 1, F.lit(1)))), lambda n: F.when(i + n - 1 <= F.size(w), F.array_join(F.slice(w, i, n), " "))))
    return F.array_distinct(F.array_compact(F.flatten(runs)))


def clean_tags(tags: Column, dropped: tuple[str, ...] = ("romance", "family")) -> Column:
    """Normal forms of tags without repeats and without tags that say nothing; empty for null."""
    return F.array_except(F.coalesce(F.transform(F.filter(tags, lambda t: t.isNotNull()), page_title), F.array().cast("array<string>")), F.array(*map(F.lit, dropped)))


def match_tags(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(url, title_clean, wiki_id, name): a tag equals a name."""
    return pages.select("url", "title_clean", F.explode("tags_clean").alias("name")).where("name <> ''").join(names, "name").select("url", "title_clean", "wiki_id", "name")


def phrases(titles: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """Rows of ``titles`` (title_clean, distinct) with those of ``names`` (name, distinct, and more columns) that occur in the title as whole words. ``most`` bounds a name's words; longer names are matched by containment of their first ``most`` words and a check."""
    grams = titles.select("title_clean", F.explode(ngrams(F.col("title_clean"), most)).alias("gram"))
    n = names.where("name <> ''").withColumn("gram", F.array_join(F.slice(F.split("name", " "), 1, most), " "))
    hit = grams.join(n, "gram")
    whole = F.instr(F.concat(F.lit(" "), "title_clean", F.lit(" ")), F.concat(F.lit(" "), F.col("name"), F.lit(" "))) > 0
    return hit.where(whole).drop("gram")


#: Records of one name that a page meets in one place; a name of more is split.
SLICE = 256


def match_phrase(pages: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(url, title_clean, wiki_id, name): a name occurs in the title as whole words; ``most`` as in ``phrases``. Distinct if pages (url, title_clean) and names are.

    These are all pairs of pages and records that share a name, so rows grow with the product of both. The
    pairs are never shuffled, and a name of many records is split into slices that run apart.
    """
    p = pages.select("url", "title_clean")
    slices = names.groupBy("name").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    named = phrases(p.select("title_clean").distinct(), slices, most).join(p, "title_clean").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    bearers = names.join(slices, "name").select("wiki_id", "name", F.pmod(F.xxhash64("wiki_id"), F.col("slices")).cast("int").alias("slice"))
    return named.join(bearers, ["name", "slice"]).select("url", "title_clean", "wiki_id", "name")


def _least(*order: Column) -> Column:
    return F.min(F.struct(*order))


def _id(name: str = "wiki_id") -> tuple[Column, Column]:
    """Order of a column with null at the end, as in SQL."""
    return F.col(name).isNull().alias("no_id"), F.col(name)


def best_phrases(pages: DataFrame, titles: DataFrame, alts: DataFrame) -> DataFrame:
    """(match_type, url, title_clean, wiki_id, name): longest phrase match of each title; ties go to the kind, the record, the page and the name in order.

    All pages of a title have the same matches, so the least page of the title and the least kind and record of
    each name decide; no pair of page and record is made that another one outranks.
    """
    kind = lambda k: F.lit(PRIORITY[k]).alias("kind")
    named = titles.select("name", kind("title"), "wiki_id").unionByName(alts.select("name", kind("alt"), "wiki_id"))
    names = named.groupBy("name").agg(_least(F.col("kind"), *_id()).alias("x")).select("name", "x.kind", "x.wiki_id")
    hit = phrases(pages.select("title_clean").distinct(), names)
    best = hit.groupBy("title_clean").agg(_least((-F.length("name")).alias("n"), F.col("kind"), *_id(), F.col("name")).alias("x"))
    first = pages.groupBy("title_clean").agg(F.min("url").alias("url"))
    kinds = F.create_map(*[F.lit(x) for p, k in PRIORITY.items() for x in (k, p)])
    return best.join(first, "title_clean").select(kinds[F.col("x.kind")].alias("match_type"), "url", "title_clean", "x.wiki_id", "x.name")


def best_tags(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(url, title_clean, wiki_id, name): of each title and name that a tag equals, the least record and page."""
    names = titles.groupBy("name").agg(_least(*_id()).alias("x")).select("name", "x.wiki_id")
    return match_tags(pages, names).groupBy("title_clean", "name").agg(F.min("url").alias("url"), F.first("wiki_id").alias("wiki_id")).select("url", "title_clean", "wiki_id", "name")


def page_keys(entities: DataFrame) -> DataFrame:
    """(url, title_clean, tags_clean) of pages with a title, row by row."""
    x = entities.select(F.coalesce("url", F.lit("")).alias("url"), page_title(F.coalesce("title", F.lit(""))).alias("title_clean"), clean_tags(F.col("tags")).alias("tags_clean"))
    return x.where("title_clean <> ''")


def prepare_pages(entities: DataFrame) -> DataFrame:
    """(url, title_clean, tags_clean) of pages with a title; repeated rows merge."""
    return page_keys(entities).distinct()


def prepare_names(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wiki_id, name) of titles and of alternative names, distinct."""
    titles = records.select("wiki_id", record_title(F.col("title")).alias("name")).where("name <> ''").distinct()
    alts = records.select("wiki_id", F.explode(name_list(F.col("alt_name"))).alias("name")).distinct()
    return titles, alts


def not_all_blank(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows with a column that is neither blank nor null; a null beside blanks counts as blank."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.col(c), F.lit("")) != "")
    return df.where(out)


def link(entities: DataFrame, records: DataFrame) -> DataFrame:
    """(match_type, url, title_clean, wiki_id, name): best phrase match of each title and all tag matches, one row per title and name."""
    pages = page_keys(entities)
    titles, alts = prepare_names(records)
    both = best_phrases(pages, titles, alts).unionByName(best_tags(pages, titles).withColumn("match_type", F.lit("tag")))
    kinds = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])
    w = Window.partitionBy("title_clean", "name").orderBy(kinds[F.col("match_type")], F.asc_nulls_last("wiki_id"), "url")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("match_type", "url", "title_clean", "wiki_id", "name")


#: The columns of a linked row: match, page, record.
PAGE_COLUMNS = ("title", "url", "description", "domain", "author", "date", "tags")
OUTPUT = ("match_type", "alt_name_item", "alt_name", "title", "title_clean", "wiki_title_clean", "wiki_title", "url", "description", "domain", "author", "date", "tags", "wiki_id", "timestamp", "username", "synopsis",
          "creator", "based_on", "writer", "director", "starring", "music", "opening_theme", "ending_theme", "executive_producer", "producer", "camera_setup", "runtime", "budget", "location", "company", "network",
          "first_aired", "last_aired", "num_seasons", "num_episodes", "genre", "language", "country")


def attach(links: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """The 40 columns of linked rows: ``links`` with the attributes of the page's first crawl and of the record's latest revision.

    Control signs become blanks, tags are joined by ``|``; null stays null.
    """
    first = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    page = entities.select("entity_id", *[F.col(c) for c in PAGE_COLUMNS if c not in ("url", "tags")], F.coalesce("url", F.lit("")).alias("url"), page_title(F.coalesce("title", F.lit(""))).alias("title_clean"), F.array_join("tags", "|").alias("tags"))
    page = page.withColumn("_n", first(("url", "title_clean"), "entity_id")).where("_n = 1").drop("_n", "entity_id")
    record = records.withColumn("_n", first(("wiki_id",), F.desc_nulls_last("timestamp"), F.desc("rec_id"))).where("_n = 1").withColumnRenamed("title", "wiki_title")
    record = record.select("wiki_id", "wiki_title", record_title(F.col("wiki_title")).alias("wiki_title_clean"), *[c for c in OUTPUT if c in record.columns and c not in ("wiki_id", "wiki_title")])
    x = links.join(page, ["url", "title_clean"]).join(record, "wiki_id").withColumn("alt_name_item", F.when(F.col("match_type") == "alt", F.col("name")))
    return x.select(*[flatten_text(F.col(c)).alias(c) for c in OUTPUT])
