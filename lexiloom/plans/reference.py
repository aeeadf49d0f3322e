"""Queries of the retrieval pipeline over whole tables and the equivalent SQL.

Pages as HTML aren't among the tables, so page queries build the HTML of each page from its entity
row and its text, and take it apart again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import normalise as N
from lexiloom.functions.register import decode_entities as decode_udf
from lexiloom.operators import crawl, index, linking, pages, wikitext
from lexiloom.runtime import table
from lexiloom.sources.readers import last_per_file

WIKI = "wiki_kdrama_final1_parquet"
QUERY = ["villain", "eats", "tangerines", "villain"]
FIELDS = ("title", "alt_name", "creator", "writer", "director", "starring", "music", "genre", "network", "company", "location", "language", "country")
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and its SQL."""
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


def _counts(spark: SparkSession, root: str) -> DataFrame:
    return index.term_counts(table(spark, root, "documents"))


WORDS = "words AS (SELECT doc_id, source, unnest(string_split(lower(text), ' ')) AS term FROM documents), kept AS (SELECT * FROM words WHERE term <> ''), counts AS (SELECT doc_id, term, count(*) AS n FROM kept GROUP BY ALL), vocab AS (SELECT term, count(*) AS df, round(ln((SELECT count(DISTINCT doc_id) FROM counts) / count(*)), 6) AS idf_ordinary, round(ln(1 + (SELECT count(DISTINCT doc_id) FROM counts) / count(*)), 6) AS idf_log FROM counts GROUP BY term), tf AS (SELECT doc_id, term, n, round(1 + ln(n), 6) AS tf FROM counts)"


@query("SELECT doc_id, len(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) AS n_words FROM documents")
def tokenize_docs(spark, root):
    return table(spark, root, "documents").select("doc_id", F.size(index.words(F.col("text"))).cast("bigint").alias("n_words"))


@query(f"WITH {WORDS} SELECT doc_id, term, n, tf FROM tf")
def term_frequency(spark, root):
    return index.weights(_counts(spark, root))


@query(f"WITH {WORDS} SELECT term, df, idf_ordinary, idf_log FROM vocab")
def doc_frequency_idf(spark, root):
    return index.vocabulary(_counts(spark, root))


@query(f"WITH {WORDS} SELECT 'documents' AS name, count(DISTINCT doc_id) AS value FROM kept UNION ALL SELECT 'words', count(*) FROM kept UNION ALL SELECT 'sites', count(DISTINCT source) FROM kept UNION ALL SELECT 'vocabulary', count(DISTINCT term) FROM kept")
def corpus_globals(spark, root):
    return index.corpus_totals(table(spark, root, "documents"))


@query(f"WITH {WORDS} SELECT term, count(*) AS doc_freq, string_agg('(' || doc_id || ':' || printf('%.6f', tf) || ')', ', ' ORDER BY doc_id) AS postings FROM tf GROUP BY term")
def postings_lists(spark, root):
    return index.postings(_counts(spark, root))


def _search_sql(idf: str, k: int = 5) -> str:
    asked = ", ".join(f"('{t}', {QUERY.count(t)})" for t in sorted(set(QUERY)))
    return f"WITH {WORDS}, asked(term, times) AS (VALUES {asked}) SELECT doc_id, round(sum(tf * {idf} * times), 6) AS score FROM tf JOIN vocab USING (term) JOIN asked USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"


@query(_search_sql("idf_log"))
def tfidf_search_log(spark, root):
    return index.search(table(spark, root, "documents"), QUERY)


@query(_search_sql("idf_ordinary"))
def tfidf_search_ordinary(spark, root):
    return index.search(table(spark, root, "documents"), QUERY, "idf_ordinary")


STOP = "(" + ", ".join(f"'{w}'" for w in N.SEARCH_STOP_WORDS) + ")"


@query(f"WITH {WORDS}, asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS term FROM eval_items) WHERE term <> '' AND term NOT IN {STOP} GROUP BY ALL), s AS (SELECT item_id, doc_id, round(sum(tf * idf_log * times), 6) AS score FROM tf JOIN vocab USING (term) JOIN asked USING (term) GROUP BY ALL) SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3")
def tfidf_search_batch(spark, root):
    asked = table(spark, root, "eval_items").select("item_id", F.filter(index.words(F.col("text")), lambda w: ~w.isin(*N.SEARCH_STOP_WORDS)).alias("terms"))
    return index.search_batch(table(spark, root, "documents"), asked)


@query(f"SELECT doc_id, score, coalesce(title, '(no title)') AS title, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE coalesce(text, '') END AS shown FROM ({_search_sql('idf_log')}) JOIN documents USING (doc_id)")
def search_with_metadata(spark, root):
    hits = index.search(table(spark, root, "documents"), QUERY)
    shown = F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, root, "documents").join(F.broadcast(hits), "doc_id").select("doc_id", "score", F.coalesce("title", F.lit("(no title)")).alias("title"), shown.alias("shown"))


FIELD_QUERY = ["romance", "haneo", "2016", "korean"]
_FIELD_ROWS = " UNION ALL ".join(f"SELECT rec_id, '{f}' AS field, list_filter(string_split(trim(regexp_replace(lower(coalesce({f}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS terms FROM {WIKI}" for f in FIELDS) + f" UNION ALL SELECT rec_id, 'num_seasons', list_filter([coalesce(num_seasons, '')], lambda w: w <> '') FROM {WIKI}"
_TERMS = f"rows_ AS ({_FIELD_ROWS}), terms AS (SELECT rec_id, field, len(terms) AS len, unnest(terms) AS term FROM rows_), n AS (SELECT rec_id, field, len, term, count(*) AS n FROM terms GROUP BY ALL), stats AS (SELECT field, count(*) AS docs, avg(len) AS avg_len FROM (SELECT DISTINCT field, rec_id, len FROM n) GROUP BY field)"


@query(f"WITH {_TERMS}, asked(term) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in FIELD_QUERY)}), hit AS (SELECT n.* FROM n JOIN asked USING (term)), df AS (SELECT field, term, count(*) AS df FROM hit GROUP BY ALL) SELECT rec_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n / (n + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM hit JOIN df USING (field, term) JOIN stats USING (field) GROUP BY rec_id ORDER BY score DESC, rec_id LIMIT 10")
def bm25_multifield(spark, root):
    return index.search_fields(index.field_terms(table(spark, root, WIKI), "rec_id", FIELDS, ("num_seasons",)), "rec_id", FIELD_QUERY)


@query(f"WITH {_TERMS} SELECT field, docs, round(avg_len, 6) AS avg_len FROM stats")
def field_statistics(spark, root):
    t = index.field_terms(table(spark, root, WIKI), "rec_id", FIELDS, ("num_seasons",))
    return t.groupBy("field", "rec_id", "len").agg(F.lit(1)).groupBy("field").agg(F.count("*").alias("docs"), F.round(F.avg("len"), 6).alias("avg_len"))


FIELD_STOP = "(" + ", ".join(f"'{w}'" for w in N.FIELD_STOP_WORDS) + ")"


@query(f"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {FIELD_STOP}), ' ') AS cleaned FROM eval_items")
def query_clean(spark, root):
    return table(spark, root, "eval_items").select("item_id", F.array_join(N.query_words(F.col("text")), " ").alias("cleaned"))


KEEP = "({w} NOT IN " + "(" + ", ".join(f"'{w}'" for w in (*N.TEXT_STOP_WORDS, *N.ENGLISH_STOP_WORDS)) + ") AND (NOT regexp_full_match({w}, '[0-9]+') OR (length({w}) <= 2 AND TRY_CAST({w} AS BIGINT) BETWEEN 1 AND 50) OR TRY_CAST({w} AS BIGINT) BETWEEN 1880 AND 2030))"
_SPLIT = "string_split(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9가-힣]', ' ', 'g')), ' +', ' ', 'g')), ' ')"


@query(f"SELECT doc_id, array_to_string(list_filter({_SPLIT}, lambda w: w <> '' AND {KEEP.format(w='w')}), ' ') AS kept FROM documents")
def stopword_number_filter(spark, root):
    w = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9가-힣]", " ")), " +", " ")), " ")
    kept = F.filter(w, lambda x: (x != "") & N.keep_word(x, (*N.TEXT_STOP_WORDS, *N.ENGLISH_STOP_WORDS)))
    return table(spark, root, "documents").select("doc_id", F.array_join(kept, " ").alias("kept"))


def _html(spark, root):
    """HTML of each page; the ways to state author, date, description, tags and the article's region take turns by ``entity_id``."""
    e = table(spark, root, "entities")
    c = lambda n: F.coalesce(F.regexp_replace(n, "[\"'<>]", ""), F.lit(""))
    k = F.col("entity_id") % 4
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    turn = lambda *ways: F.when(k == 0, ways[0]).when(k == 1, ways[1]).when(k == 2, ways[2]).otherwise(ways[3])
    author = turn(text('<meta name="author" content="', c("author"), '">'), text('<span class="author vcard"> <a class="n">', c("author"), "</a></span>"),
                  text('<script type="application/ld+json">{"author": {"@type": "Person", "name": "', c("author"), '"}}</script>'), text('<META content="', c("author"), "\" name='author' />"))
    date = turn(text('<meta content="', c("date"), '" property="article:published_time">'), text('<time class="entry-date published" datetime="', c("date"), '">x</time>'),
                text('<script>{"datePublished": "', c("date"), '"}</script>'), text('<meta property="article:published_time" content=""><time class="published" datetime="', c("date"), '">x</time>'))
    said = turn(text('<meta property="og:description" content="', c("description"), '">'), text('<meta name="description" content="', c("description"), '">'),
                text('<meta content="', c("description"), '" property="description">'), text('<meta name="description" content=" "><meta content="', c("description"), '" property="og:description">'))
    tag = F.when(k % 2 == 0, F.lit('<a rel="tag">')).otherwise(F.lit('<a class="post_tags" x="1">'))
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(tag, F.coalesce(t, F.lit("")), F.lit("</a>"))), "")
    banner = F.when(k % 2 == 0, text('<section class="banner-top">', tags, "</section>")).otherwise(F.lit('<section class="banner-top"></section>'))
    opened = turn(F.lit('<article class="x">'), F.lit('<div id="content" class="y">'), F.lit('<main class="z">'), F.lit(""))
    closed = turn(F.lit("</article>"), F.lit('<div class="comments">Said</div></div>'), F.lit("</main>"), F.lit(""))
    return e.select("entity_id", "url", "tags", F.concat(
        F.lit("<html><head><title>\n"), c("title"), F.lit("</title>"), author, date, said, F.lit('<meta property="og:url" content="'), c("url"), F.lit('"></head>'), banner, tags,
        F.lit('<body><nav>Home</nav><script>var a = "<p>";</script>'), opened, F.lit("<p>"), c("description"), F.lit("</p><!-- note --><aside>Related</aside>"),
        F.lit('<a href="/page/3/">3</a><a href="'), c("url"), F.lit('?q=1#top">self</a><a href="/tag/x/">t</a><a href="https://other.example/a">o</a>'), closed, F.lit("</body></html>")).alias("html"))


_C = "coalesce(trim(regexp_replace(regexp_replace({c}, '[\"''<>]', '', 'g'), '\\s+', ' ', 'g')), '')"


@query("SELECT entity_id, " + ", ".join(f"{_C.format(c=c)} AS {c}" for c in ("title", "author", "date", "description")) + f", {_C.format(c='url')} AS url FROM entities")
def page_attributes(spark, root):
    a = pages.attributes(F.col("html"))
    return _html(spark, root).select("entity_id", *[a[n].alias(n) for n in ("title", "author", "date", "description", "url")])


@query("SELECT entity_id, CASE WHEN contains(coalesce(url, ''), '/shows/') AND entity_id % 2 = 1 THEN '' ELSE array_to_string(list_filter(coalesce(tags, []), lambda t, i: length(trim(t)) > 1 AND list_position(tags, t) = i), '|') END AS tags FROM entities")
def page_tags(spark, root):
    return _html(spark, root).select("entity_id", F.array_join(pages.attributes(F.col("html"))["tags"], "|").alias("tags"))


@query("SELECT entity_id, trim(regexp_replace(lower(regexp_replace(coalesce(regexp_replace(description, '[\"''<>]', '', 'g'), '') || '  3 self t o', '[^a-zA-Z0-9가-힣]', ' ', 'g')), '\\s+', ' ', 'g')) AS main FROM entities")
def main_text(spark, root):
    return _html(spark, root).select("entity_id", pages.main_text(F.col("html")).alias("main"))


SEGMENTS, TYPES = "|".join(pages.SKIPPED_SEGMENTS), "|".join(pages.SKIPPED_TYPES)
WANTED = f"NOT regexp_matches(lower({{u}}), '/({SEGMENTS})(/|$)') AND NOT regexp_matches(lower({{u}}), '\\.({TYPES})(\\?|$)') AND NOT regexp_matches(lower({{u}}), '/tag/|/wp-|comment')"


@query(f"WITH u AS (SELECT DISTINCT regexp_replace(url, '[\"''<>]', '', 'g') AS src FROM entities WHERE url LIKE 'http%'), l AS (SELECT src, src AS dst FROM u UNION SELECT src, regexp_extract(src, '^([a-z]+://[^/?#]*)', 1) || '/page/3/' FROM u) SELECT DISTINCT src, regexp_replace(regexp_replace(dst, '[?#].*$', ''), '/+$', '') AS dst FROM l WHERE {WANTED.format(u='dst')}")
def extract_links(spark, root):
    html = _html(spark, root).where(F.col("url").startswith("http")).select("url", "html")
    return pages.links(html)


@query(f"SELECT log_id, CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/$') THEN regexp_replace(url, '[?#].*$', '') ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') END AS canonical, {WANTED.format(u='url')} AND NOT (lower(url) LIKE '%haengul-notes%' AND coalesce(TRY_CAST(nullif(regexp_extract(lower(url), '/page/([0-9]+)/', 1), '') AS BIGINT), 0) > 46) AS wanted FROM page_log")
def canonical_links(spark, root):
    return table(spark, root, "page_log").select("log_id", pages.canonical(F.col("url")).alias("canonical"), pages.wanted_link(F.col("url"), {"haengul-notes": 46}).alias("wanted"))


@query("SELECT DISTINCT url FROM entities WHERE url LIKE 'http%' AND url NOT IN (SELECT url FROM page_log WHERE status = 200 AND url IS NOT NULL)")
def link_anti_visited(spark, root):
    seen = table(spark, root, "page_log").where("status = 200").select("url")
    return table(spark, root, "entities").where("url like 'http%'").select("url").distinct().join(seen, "url", "left_anti")


@query("WITH l AS (SELECT url, file, status, length, depth, datetime FROM page_log WHERE url IS NOT NULL) SELECT url, file, status, length, depth, datetime FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY datetime DESC NULLS LAST, log_id DESC) AS n FROM page_log WHERE url IS NOT NULL) WHERE n = 1")
def page_log_latest(spark, root):
    log = table(spark, root, "page_log").where("url is not null")
    x = log.groupBy("url").agg(F.max_by(F.struct("file", "status", "length", "depth", "datetime"), F.struct(F.coalesce("datetime", F.lit("")), "log_id")).alias("x"))
    return x.select("url", "x.*")


@query("SELECT log_id FROM page_log WHERE status = 200 AND (file LIKE '%.html' OR log_id % 7 = 0) AND depth <= 6")
def fetched_html(spark, root):
    kind = F.when(F.col("file").endswith(".html"), "text/html").when(F.col("log_id") % 7 == 0, "Text/HTML; charset=utf-8").when(F.col("log_id") % 7 == 1, "image/png")
    return table(spark, root, "page_log").where(pages.is_html(F.col("status"), kind) & (F.col("depth") <= 6)).select("log_id")


@query("SELECT DISTINCT log_id FROM page_log WHERE url IS NOT NULL AND NOT regexp_matches(url, '^https?://[^/]+/(tag|comment)') AND NOT (lower(url) LIKE '%haengul-notes.example/page/%' AND NOT lower(url) LIKE '%haengul-notes.example/page/1%')")
def robots_filter(spark, root):
    log = table(spark, root, "page_log").where("url is not null")
    hosts = log.select(pages.netloc(F.col("url")).alias("host")).distinct()
    rules = hosts.select("host", F.explode(F.array(F.lit("/tag"), F.lit("/comment"))).alias("prefix")).unionByName(hosts.where(F.col("host").endswith("haengul-notes.example")).select("host", F.explode(F.array(F.lit("/page/"), F.lit("/page/1"))).alias("prefix"))).withColumn("allow", F.col("prefix") == "/page/1")
    return pages.robots_allowed(log, rules).select("log_id").distinct()


@query("SELECT log_id, left(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9_-]+', '_', 'g'), 80) || '.html' AS name FROM page_log")
def page_file_name(spark, root):
    return table(spark, root, "page_log").select("log_id", pages.file_name(F.col("url")).alias("name"))


PHRASES = ("open_thread", "weekly_ratings", "award", "about_us")
_REASON = "CASE WHEN length < 20000 THEN 'small' WHEN regexp_matches(lower(file), '^(www_)?[a-z0-9-]+_(com|example)(_\\d{0,4})?(_\\d{0,2})?_?(\\.html)?$') OR lower(file) = 'index.html' THEN 'root' WHEN " + " OR ".join(f"contains(lower(file), '{p}')" for p in PHRASES) + " THEN 'phrase' END"


@query(f"SELECT log_id, {_REASON} AS reason FROM page_log WHERE file IS NOT NULL")
def filter_reason(spark, root):
    return table(spark, root, "page_log").where("file is not null").select("log_id", pages.skip_reason(F.col("file"), F.col("length"), PHRASES, 20000, endings=("com", "example")).alias("reason"))


@query(f"SELECT split_part(file, '_', 1) AS site, count(*) AS total, count(*) FILTER (WHERE {_REASON} IS NULL) AS kept FROM page_log WHERE file IS NOT NULL GROUP BY 1")
def filter_stats(spark, root):
    x = table(spark, root, "page_log").where("file is not null")
    return x.groupBy(F.split_part("file", F.lit("_"), F.lit(1)).alias("site")).agg(F.count("*").alias("total"), F.count_if(pages.skip_reason(F.col("file"), F.col("length"), PHRASES, 20000, endings=("com", "example")).isNull()).alias("kept"))


EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


@query(f"WITH RECURSIVE {EDGES}, reach(url, depth) AS (SELECT 'c1', 0 UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = url WHERE depth < 4) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY url")
def bfs_crawl(spark, root):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, root, "nation")
    edges = (table(spark, root, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
             .union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(nation.select(name("r", "n_regionkey"), name("n", "n_nationkey")))
             .union(table(spark, root, "supplier").select(name("n", "s_nationkey"), name("s", "s_suppkey"))))
    return crawl.crawl(spark.createDataFrame([("c1",)], "url string"), edges, 4)


@query("SELECT file, arg_max(title, entity_id) AS title, max(entity_id) AS entity_id FROM (SELECT file, entity_id, coalesce(title, '') AS title FROM entities) GROUP BY file")
def entities_last_per_file(spark, root):
    e = table(spark, root, "entities").select("file", "entity_id", F.coalesce("title", F.lit("")).alias("title"), F.col("entity_id").alias("_order"))
    return last_per_file(e, "_order").select("file", "title", "entity_id")


_PT = "trim(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_RT = "trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_ALT = "list_filter(list_transform(string_split(regexp_replace(lower(alt_name), '[^a-z0-9,\\s]', '', 'g'), ','), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_TAGS = f"list_filter(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL), lambda t: {_PT.format(c='t')})), lambda t: t NOT IN ('romance', 'family'))"
_PAGES = f"pages_ AS (SELECT DISTINCT coalesce(url, '') AS url, {_PT.format(c='title')} AS title_clean, list_sort({_TAGS}) AS tags_clean FROM entities), pages AS (SELECT * FROM pages_ WHERE title_clean <> '')"
_NAMES = f"titles AS (SELECT DISTINCT wiki_id, {_RT} AS name FROM {WIKI} WHERE {_RT} <> ''), alts AS (SELECT DISTINCT wiki_id, unnest({_ALT}) AS name FROM {WIKI})"
_TAG = "bytag AS (SELECT DISTINCT url, title_clean, wiki_id, name FROM (SELECT url, title_clean, unnest(tags_clean) AS name FROM pages) JOIN titles USING (name) WHERE name <> '')"


def _grams(names: str, out: str) -> str:
    return f"{out} AS (SELECT DISTINCT url, title_clean, wiki_id, name FROM (SELECT DISTINCT url, title_clean, array_to_string(w[i:i + k - 1], ' ') AS name FROM (SELECT url, title_clean, string_split(title_clean, ' ') AS w FROM pages), range(1, 25) AS a(i), range(1, 16) AS b(k) WHERE i + k - 1 <= len(w)) JOIN {names} USING (name))"


def _names(spark, root):
    e, w = table(spark, root, "entities"), table(spark, root, WIKI)
    return linking.prepare_pages(e), *linking.prepare_names(w)


@query(f"WITH {_PAGES}, {_NAMES}, {_TAG} SELECT * FROM bytag")
def link_by_tags(spark, root):
    p, titles, _ = _names(spark, root)
    return linking.match_tags(p, titles).distinct()


@query(f"WITH {_PAGES}, {_NAMES}, {_grams('titles', 'bytitle')} SELECT * FROM bytitle")
def link_by_title(spark, root):
    p, titles, _ = _names(spark, root)
    return linking.match_phrase(p, titles).distinct()


@query(f"WITH {_PAGES}, {_NAMES}, {_grams('alts', 'byalt')} SELECT * FROM byalt")
def link_by_alt(spark, root):
    p, _, alts = _names(spark, root)
    return linking.match_phrase(p.select("url", "title_clean").distinct(), alts)


_KINDS = "kinds(match_type, kind) AS (VALUES ('title', 0), ('alt', 1), ('tag', 2))"
_BEST = f"WITH {_PAGES}, {_NAMES}, {_TAG}, {_grams('titles', 'bytitle')}, {_grams('alts', 'byalt')}, {_KINDS}, phrase AS (SELECT 'title' AS match_type, * FROM bytitle UNION ALL SELECT 'alt', * FROM byalt), best AS (SELECT match_type, url, title_clean, wiki_id, name FROM (SELECT *, row_number() OVER (PARTITION BY title_clean ORDER BY length(name) DESC, kind, wiki_id, url, name) AS n FROM phrase JOIN kinds USING (match_type)) WHERE n = 1)"


@query(f"{_BEST} SELECT * FROM best")
def link_best_match(spark, root):
    p, titles, alts = linking.page_keys(table(spark, root, "entities")), *linking.prepare_names(table(spark, root, WIKI))
    return linking.best_phrases(p, titles, alts)


@query(f"{_BEST} SELECT match_type, url, title_clean, wiki_id, name FROM (SELECT *, row_number() OVER (PARTITION BY title_clean, name ORDER BY kind, wiki_id, url) AS n FROM (SELECT * FROM best UNION ALL SELECT 'tag', * FROM bytag) JOIN kinds USING (match_type)) WHERE n = 1")
def link_full(spark, root):
    return linking.link(table(spark, root, "entities"), table(spark, root, WIKI))


#: The fields that the multi-field search can match, over linked rows of page and record; the two derived years are indexed, not searched.
JOINED = ("title", "tags", "alt_name", "creator", "based_on", "writer", "director", "starring", "music", "producer", "executive_producer", "location", "company", "genre", "wiki_title", "network", "language", "country", "num_episodes")
JOINED_EXACT = ("num_seasons", "first_aired_year", "last_aired_year")
_YEAR = "coalesce(regexp_extract({c}, '(^|[^0-9A-Za-z_가-힣])(\\d{{4}})($|[^0-9A-Za-z_가-힣])', 2), '')"
_JOINED = (f"links AS ({SQL['link_full']}), page AS (SELECT coalesce(url, '') AS url, {_PT.format(c='title')} AS title_clean, title, array_to_string(tags, '|') AS tags, row_number() OVER (PARTITION BY coalesce(url, ''), {_PT.format(c='title')} ORDER BY entity_id) AS n FROM entities), "
           f"rec AS (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY timestamp DESC NULLS LAST, rec_id DESC) AS rn FROM {WIKI}), "
           "joined AS (SELECT links.title_clean || chr(9) || links.name AS link, page.title AS title, page.tags AS tags, rec.title AS wiki_title, " + ", ".join(f"rec.{c} AS {c}" for c in (*JOINED, "num_seasons") if c not in ("title", "tags", "wiki_title"))
           + f", {_YEAR.format(c='rec.first_aired')} AS first_aired_year, {_YEAR.format(c='rec.last_aired')} AS last_aired_year FROM links JOIN page ON page.n = 1 AND page.url = links.url AND page.title_clean = links.title_clean JOIN rec ON rec.rn = 1 AND rec.wiki_id = links.wiki_id)")
_JOINED_ROWS = " UNION ALL ".join([f"SELECT link, '{f}' AS field, list_filter(string_split(trim(regexp_replace(lower(coalesce({f}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS terms FROM joined" for f in JOINED] + [f"SELECT link, '{f}', list_filter([coalesce({f}, '')], lambda w: w <> '') FROM joined" for f in JOINED_EXACT])
_JOINED_TERMS = f"{_JOINED}, rows_ AS ({_JOINED_ROWS}), terms AS (SELECT link, field, len(terms) AS len, unnest(terms) AS term FROM rows_), n AS (SELECT link, field, len, term, count(*) AS n FROM terms GROUP BY ALL), stats AS (SELECT field, count(*) AS docs, avg(len) AS avg_len FROM (SELECT DISTINCT field, link, len FROM n) GROUP BY field)"


def _joined_fields(spark, root, query=()):
    """(link, field, len, asked) of linked rows: a page's and a record's terms are counted once, before the join repeats them."""
    first = lambda *order: F.row_number().over(Window.partitionBy(*order[0]).orderBy(*order[1:]))
    page = table(spark, root, "entities").select("entity_id", F.coalesce("url", F.lit("")).alias("url"), N.page_title(F.coalesce("title", F.lit(""))).alias("title_clean"), "title", F.array_join("tags", "|").alias("tags"))
    page = page.withColumn("_n", first(("url", "title_clean"), "entity_id")).where("_n = 1").select("url", "title_clean", index.field_parts(("title", "tags"), (), query).alias("page_parts"))
    rec = table(spark, root, WIKI).withColumn("_n", first(("wiki_id",), F.desc_nulls_last("timestamp"), F.desc("rec_id"))).where("_n = 1").withColumnRenamed("title", "wiki_title")
    rec = rec.withColumns({f"{c}_year": F.coalesce(N.first_year(F.col(c)), F.lit("")) for c in ("first_aired", "last_aired")})
    rec = rec.select("wiki_id", index.field_parts(tuple(c for c in JOINED if c not in ("title", "tags")), JOINED_EXACT, query).alias("rec_parts"))
    x = link_full(spark, root).join(page, ["url", "title_clean"]).join(rec, "wiki_id")
    return x.select(F.concat_ws("\t", "title_clean", "name").alias("link"), F.inline(F.concat("page_parts", "rec_parts")))


@query(f"WITH {_JOINED_TERMS}, asked(term) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in FIELD_QUERY)}), hit AS (SELECT n.* FROM n JOIN asked USING (term) WHERE field NOT LIKE '%_year'), df AS (SELECT field, term, count(*) AS df FROM hit GROUP BY ALL) SELECT link, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n / (n + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM hit JOIN df USING (field, term) JOIN stats USING (field) GROUP BY link ORDER BY score DESC, link LIMIT 10")
def bm25_joined(spark, root):
    x = _joined_fields(spark, root, tuple(FIELD_QUERY)).where(~F.col("field").endswith("_year"))
    return index.search_parts(x, "link", FIELD_QUERY)


@query(f"WITH {_JOINED_TERMS} SELECT field, docs, round(avg_len, 6) AS avg_len FROM stats")
def joined_field_statistics(spark, root):
    return index.parts_statistics(_joined_fields(spark, root)).select("field", "docs", F.round("avg_len", 6).alias("avg_len"))


#: All attributes but names, network, language and country: a record with none of them says nothing.
BLANKABLE = tuple(c for c in wikitext.ATTRIBUTES if c not in ("alt_name", "network", "language", "country"))


@query(f"SELECT rec_id FROM {WIKI} WHERE " + " OR ".join(f"coalesce({c}, '') <> ''" for c in BLANKABLE))
def not_all_blank(spark, root):
    return linking.not_all_blank(table(spark, root, WIKI), BLANKABLE).select("rec_id")


@query(f"SELECT entity_id, array_to_string(list_sort({_TAGS}), '|') AS tags_clean FROM entities")
def array_except_dedup(spark, root):
    return table(spark, root, "entities").select("entity_id", F.array_join(F.array_sort(linking.clean_tags(F.col("tags"))), "|").alias("tags_clean"))


@query("SELECT entity_id, unnest(CASE WHEN len(coalesce(tags, [])) = 0 THEN [NULL] ELSE tags END) AS tag FROM entities")
def explode_outer_tags(spark, root):
    return table(spark, root, "entities").select("entity_id", F.explode_outer("tags").alias("tag"))


@query(f"SELECT wiki_id, title AS name, 'title' AS kind FROM {WIKI} UNION ALL SELECT wiki_id, alt_name, 'alt' FROM {WIKI}")
def union_by_name(spark, root):
    w = table(spark, root, WIKI)
    return w.select("wiki_id", F.col("title").alias("name"), F.lit("title").alias("kind")).unionByName(w.select(F.lit("alt").alias("kind"), F.col("alt_name").alias("name"), "wiki_id"))


@query(f"SELECT rec_id, coalesce(regexp_extract(first_aired, '(^|[^0-9A-Za-z_가-힣])(\\d{{4}})($|[^0-9A-Za-z_가-힣])', 2), '') AS year FROM {WIKI}")
def extract_year(spark, root):
    return table(spark, root, WIKI).select("rec_id", F.coalesce(N.first_year(F.col("first_aired")), F.lit("")).alias("year"))


@query(f"SELECT 'page' AS kind, entity_id AS id, {_PT.format(c='title')} AS name FROM entities UNION ALL SELECT 'record', rec_id, coalesce({_RT}, '') FROM {WIKI} UNION ALL SELECT 'alt', rec_id, coalesce(array_to_string({_ALT}, '|'), '') FROM {WIKI}")
def normalize_title(spark, root):
    e, w = table(spark, root, "entities"), table(spark, root, WIKI)
    return (e.select(F.lit("page").alias("kind"), F.col("entity_id").alias("id"), N.page_title(F.coalesce("title", F.lit(""))).alias("name"))
            .unionByName(w.select(F.lit("record").alias("kind"), F.col("rec_id").alias("id"), F.coalesce(N.record_title(F.col("title")), F.lit("")).alias("name")))
            .unionByName(w.select(F.lit("alt").alias("kind"), F.col("rec_id").alias("id"), F.coalesce(F.array_join(N.name_list(F.col("alt_name")), "|"), F.lit("")).alias("name"))))


_FLAT = ("title", "alt_name", "starring", "genre", "synopsis")


@query("SELECT rec_id, " + ", ".join(f"regexp_replace({c}, '[\\x00-\\x1f]+', ' ', 'g') AS {c}" for c in _FLAT) + f" FROM {WIKI}")
def flatten_whitespace_all(spark, root):
    return table(spark, root, WIKI).select("rec_id", *[N.flatten_text(F.col(c)).alias(c) for c in _FLAT])


@query("SELECT entity_id, url, CASE WHEN len(coalesce(tags, [])) > 0 THEN array_to_string(tags, '|') ELSE '' END AS tags FROM entities")
def tags_joined(spark, root):
    return table(spark, root, "entities").select("entity_id", "url", F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"))


_BOX = ("creator", "writer", "director", "music", "network", "company", "location", "num_episodes", "language", "country")


def _wikitext(spark, root, box=_BOX):
    """Wiki text of each record; an attribute's keys and the ends of the box take turns by ``rec_id``."""
    w = table(spark, root, WIKI)
    key = lambda c: F.get(F.array(*map(F.lit, wikitext.ATTRIBUTES[c])), (F.col("rec_id") % len(wikitext.ATTRIBUTES[c])).cast("int"))
    rows = [F.concat(F.lit("| "), key(c), F.lit(" = "), F.coalesce(F.col(c), F.lit("")), F.lit("\n")) for c in box]
    end = F.when(F.col("rec_id") % 3 == 0, "}}\n\n").when(F.col("rec_id") % 3 == 1, "}}{{Unreliable sources|x}}\n\n").otherwise("}}'\n\n")
    text = F.concat(F.lit("Intro.\n{{Infobox television\n"), *rows, end, F.lit("== Plot ==\n"), F.coalesce("synopsis", F.lit("")), F.lit("\n\n== Cast ==\n* A"))
    return w.select("rec_id", "wiki_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("username", F.lit("")).alias("username"), text.alias("text"))


@query("SELECT rec_id, " + ", ".join(f"coalesce(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '') AS {c}" for c in _BOX) + f" FROM {WIKI}")
def wiki_infobox(spark, root):
    x = _wikitext(spark, root).withColumn("box", wikitext.infobox(F.col("text")))
    raw = F.array(*[F.coalesce(*[F.try_element_at("box", F.lit(k)) for k in wikitext.ATTRIBUTES[c]]) for c in _BOX])
    return x.withColumn("values", F.transform(raw, wikitext.clean_value)).select("rec_id", *[F.get("values", i).alias(c) for i, c in enumerate(_BOX)])


@query(f"SELECT wiki_id, replace(trim(title), '&amp;', '&') AS title FROM {WIKI} WHERE contains(lower(coalesce(country, '')), 'south korea') AND contains(lower(coalesce(language, '')), 'korean')")
def wiki_qualify(spark, root):
    return wikitext.records(_wikitext(spark, root)).select("wiki_id", F.trim("title").alias("title"))


@query()
def wiki_infobox_all(spark, root):
    """All attributes of a record, read back from an infobox that holds all of them."""
    x = _wikitext(spark, root, tuple(wikitext.ATTRIBUTES)).withColumn("box", wikitext.infobox(F.col("text")))
    raw = F.array(*[F.coalesce(*[F.try_element_at("box", F.lit(k)) for k in keys]) for keys in wikitext.ATTRIBUTES.values()])
    return x.withColumn("values", F.transform(raw, wikitext.clean_value)).select("rec_id", *[F.get("values", i).alias(c) for i, c in enumerate(wikitext.ATTRIBUTES)])


@query()
def wiki_records(spark, root):
    """All 29 columns of the records that qualify."""
    return wikitext.records(_wikitext(spark, root, tuple(wikitext.ATTRIBUTES)))


@query()
def wiki_clean_fields(spark, root):
    """Whole fields with markup, cleaned."""
    fields = ("alt_name", "starring", "budget", "runtime", "genre", "first_aired", "last_aired", "synopsis")
    x = table(spark, root, WIKI).select("rec_id", F.transform(F.array(*fields), wikitext.clean_value).alias("values"))
    return x.select("rec_id", *[F.get("values", i).alias(c) for i, c in enumerate(fields)])


@query()
def decode_entities_fields(spark, root):
    """Whole fields with all HTML 5 references decoded."""
    return table(spark, root, WIKI).select("rec_id", decode_udf(F.col("alt_name")).alias("alt_name"), decode_udf(F.col("synopsis")).alias("synopsis"))


@query("SELECT match_type, count(*) AS n, count(DISTINCT wiki_id) AS records FROM (" + SQL["link_full"] + ") GROUP BY match_type")
def link_report(spark, root):
    return link_full(spark, root).groupBy("match_type").agg(F.count("*").alias("n"), F.countDistinct("wiki_id").alias("records"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
