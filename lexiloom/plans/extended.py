"""Queries of stored index, linked output, page rules and the wiki dump over whole tables, and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import normalise as N
from lexiloom.functions.domains import host_of
from lexiloom.functions.register import decode_entities as decode_udf
from lexiloom.functions.text import decode_char_refs, let
from lexiloom.operators import index, linking, pages, wikitext
from lexiloom.plans import reference as R
from lexiloom.runtime import cut, shared_folder, table

WIKI = R.WIKI
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query and its SQL."""
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return add


# stored index ------------------------------------------------------------------------------------

#: Analysed, exact and stored-only fields of a record.
FIELDS = ("title", "alt_name", "creator", "based_on", "writer", "director", "starring", "music", "producer", "executive_producer", "location", "company", "genre", "network", "language", "country", "num_episodes")
EXACT = ("num_seasons", "first_aired_year", "last_aired_year")
STORED = ("runtime", "budget", "camera_setup", "opening_theme", "ending_theme", "synopsis", "first_aired", "last_aired")
SEARCHED = (*FIELDS, "num_seasons")
_YEARS = f"recs AS (SELECT *, {R._YEAR.format(c='first_aired')} AS first_aired_year, {R._YEAR.format(c='last_aired')} AS last_aired_year FROM {WIKI})"
_ROWS = " UNION ALL ".join([f"SELECT rec_id, '{f}' AS field, list_filter(string_split(trim(regexp_replace(lower(coalesce({f}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS terms FROM recs" for f in FIELDS]
                           + [f"SELECT rec_id, '{f}', list_filter([coalesce({f}, '')], lambda w: w <> '') FROM recs" for f in EXACT])
_TOKENS = f"{_YEARS}, rows_ AS ({_ROWS}), terms AS (SELECT rec_id, field, len(terms) AS len, unnest(terms) AS term FROM rows_), n AS (SELECT rec_id, field, len, term, count(*) AS n FROM terms GROUP BY ALL)"
_HITS = (f"{_TOKENS}, stats AS (SELECT field, count(*) AS docs, avg(len) AS avg_len FROM (SELECT DISTINCT field, rec_id, len FROM n) GROUP BY field), asked(term) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in R.FIELD_QUERY)}), "
         f"hit AS (SELECT n.* FROM n JOIN asked USING (term) WHERE field NOT LIKE '%_year'), df AS (SELECT field, term, count(*) AS df FROM hit GROUP BY ALL), "
         "found AS (SELECT rec_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n / (n + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM hit JOIN df USING (field, term) JOIN stats USING (field) GROUP BY rec_id ORDER BY score DESC, rec_id LIMIT 10)")


def _stored(spark, root):
    """Path of a stored index of all records."""
    path = shared_folder(spark, "index")
    recs = table(spark, root, WIKI).withColumns({f"{c}_year": F.coalesce(N.first_year(F.col(c)), F.lit("")) for c in ("first_aired", "last_aired")})
    index.store_fields(recs, "rec_id", path, FIELDS, EXACT, STORED)
    return path


@query(f"WITH {_TOKENS} SELECT rec_id, field, term, n, len FROM n")
def index_fields(spark, root):
    return spark.read.parquet(f"{_stored(spark, root)}/field_tokens").select("rec_id", "field", "term", "n", F.col("len").cast("bigint").alias("len"))


@query(f"WITH {_HITS} SELECT rec_id, score FROM found")
def search_stored(spark, root):
    return index.search_index(spark, _stored(spark, root), "rec_id", R.FIELD_QUERY, fields=SEARCHED)


@query(f"WITH {_HITS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT rec_id, score, '{c}' AS field, {c} AS value FROM found JOIN recs USING (rec_id)" for c in (*FIELDS, *EXACT, *STORED) if c != "synopsis") + ") WHERE trim(value) <> ''")
def search_stored_rows(spark, root):
    path = _stored(spark, root)
    return index.stored_rows(spark, path, index.search_index(spark, path, "rec_id", R.FIELD_QUERY, fields=SEARCHED), "rec_id", ("synopsis",))


@query(f"WITH hits AS ({R._search_sql('idf_log', 20)}), place AS (SELECT doc_id, min(path) AS path FROM docs GROUP BY doc_id), page AS (SELECT file, arg_max({{title: title, description: description, url: url, tags: tags}}, entity_id) AS e FROM entities GROUP BY file) "
       "SELECT doc_id, score, coalesce(e.title, '(no title)') AS title, coalesce(e.description, '') AS description, coalesce(e.url, '') AS url, coalesce(array_to_string(e.tags, ', '), '') AS tags "
       "FROM hits LEFT JOIN place USING (doc_id) LEFT JOIN page ON page.file = regexp_replace(regexp_replace(path, '^.*/', ''), '[.]txt$', '.html')")
def search_entities(spark, root):
    """Hits with the entity of their page, by file name; defaults where there is none."""
    hits = index.search(table(spark, root, "documents"), R.QUERY, k=20)
    place = table(spark, root, "docs").groupBy("doc_id").agg(F.min("path").alias("path"))
    e = table(spark, root, "entities")
    page = e.groupBy("file").agg(F.max_by(F.struct("title", "description", "url", "tags"), "entity_id").alias("e"))
    name = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.txt$", ".html")
    x = hits.join(place, "doc_id", "left").withColumn("file", name).join(page, "file", "left")
    return x.select("doc_id", "score", F.coalesce("e.title", F.lit("(no title)")).alias("title"), *[F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c) for c in ("description", "url")], F.coalesce(F.array_join("e.tags", ", "), F.lit("")).alias("tags"))


@query(f"WITH {R.WORDS} SELECT term, doc_id // 256 AS block, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids, count(*) AS n FROM tf GROUP BY ALL")
def postings_blocks(spark, root):
    b = index.postings_blocks(R._counts(spark, root), 256)
    return b.select("term", "block", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("bigint").alias("n"))


# linked output -----------------------------------------------------------------------------------

_CONTROL = "regexp_replace({c}, '[\\x00-\\x1f]+', ' ', 'g')"
_PAGE_COLS = ("title", "description", "domain", "author", "date")
_REC_COLS = tuple(c for c in linking.OUTPUT if c not in ("match_type", "alt_name_item", "title_clean", "wiki_title_clean", "wiki_title", "wiki_id", "url", "tags", *_PAGE_COLS))


@query(f"WITH links AS ({R.SQL['link_full']}), page AS (SELECT coalesce(url, '') AS url, {R._PT.format(c='title')} AS title_clean, {', '.join(_PAGE_COLS)}, array_to_string(tags, '|') AS tags, row_number() OVER (PARTITION BY coalesce(url, ''), {R._PT.format(c='title')} ORDER BY entity_id) AS n FROM entities), "
       f"rec AS (SELECT *, title AS wiki_title, {R._RT} AS wiki_title_clean, row_number() OVER (PARTITION BY wiki_id ORDER BY timestamp DESC NULLS LAST, rec_id DESC) AS rn FROM {WIKI}) SELECT match_type, CASE WHEN match_type = 'alt' THEN name END AS alt_name_item, page.title_clean, wiki_title_clean, "
       + ", ".join(f"{_CONTROL.format(c=f'{t}.{c}')} AS {c}" for t, cs in (("page", (*_PAGE_COLS, "url", "tags")), ("rec", (*_REC_COLS, "wiki_title", "wiki_id"))) for c in cs)
       + " FROM links JOIN page ON page.n = 1 AND page.url = links.url AND page.title_clean = links.title_clean JOIN rec ON rec.rn = 1 AND rec.wiki_id = links.wiki_id")
def link_output(spark, root):
    e, w = table(spark, root, "entities"), table(spark, root, WIKI)
    return linking.attach(linking.link(e, w), e, w)


# pages -------------------------------------------------------------------------------------------

SITE_PHRASES = {"haengul-notes": ("finale", "interview"), "recapharbor": ("review",), "plotsparrow": ("award", "open_thread", "ratings")}
MARKERS = {"beanlantern": ("Recap", "REVIEW", "drama talk")}
_NAME, _SITE = "regexp_replace(regexp_replace(path, '^.*/', ''), '[.]txt$', '.html')", "split_part(regexp_replace(path, '^.*/', ''), '_', 1)"
_SKIP = ("CASE WHEN length(coalesce(text, '')) < 700 THEN 'small' WHEN regexp_matches(lower(name), '^(www_)?[a-z0-9-]+_example(_\\d{0,4})?(_\\d{0,4})?_?(\\.html)?$') OR lower(name) = 'index.html' THEN 'root' WHEN "
         + " OR ".join(f"(site = '{s}' AND contains(lower(name), '{p}'))" for s, ps in SITE_PHRASES.items() for p in ps) + " THEN 'phrase' WHEN "
         + " OR ".join(f"(site = '{s}' AND NOT (" + " OR ".join(f"contains(lower(coalesce(text, '')), '{m.lower()}')" for m in ms) + "))" for s, ms in MARKERS.items()) + " THEN 'topic' END")


@query(f"SELECT page_id, {_SKIP} AS reason FROM (SELECT page_id, text, {_NAME} AS name, {_SITE} AS site FROM data_extracted WHERE path IS NOT NULL)")
def page_filter(spark, root):
    """The rule by which each page is skipped, with lists and topic markers by site."""
    x = table(spark, root, "data_extracted").where("path is not null").select("page_id", "text", F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.txt$", ".html").alias("name"))
    site = F.split_part("name", F.lit("_"), F.lit(1))
    size = F.length(F.coalesce("text", F.lit("")))
    return x.select("page_id", pages.skip_reason(F.col("name"), size, SITE_PHRASES, 700, site, F.col("text"), MARKERS, ("example",)).alias("reason"))


@query("SELECT domain, name, arg_max(url, log_id) AS url FROM (SELECT log_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS domain, "
       "left(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9_-]+', '_', 'g'), 80) || '.html' AS name FROM page_log WHERE url IS NOT NULL) GROUP BY domain, name")
def saved_pages(spark, root):
    return pages.saved_pages(table(spark, root, "page_log"), "log_id")


@query("SELECT entity_id, CASE WHEN contains(url, '/shows/') THEN 'show' WHEN contains(url, 'recap') THEN 'recap' ELSE 'other' END AS kind, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z][a-z0-9+.-]*:(//)?', ''), '[/?#].*$', ''), '^www[0-9]?[.]|:[0-9]*$|[.]$', '', 'g'), '') AS domain FROM entities")
def page_types(spark, root):
    return table(spark, root, "entities").select("entity_id", pages.page_type(F.col("url")).alias("kind"), host_of(F.col("domain")).alias("domain"))


_FLAT = "trim(regexp_replace(lower(regexp_replace({c}, '[^a-zA-Z0-9가-힣]', ' ', 'g')), '\\s+', ' ', 'g'))"
_CLEANED = "coalesce(trim(regexp_replace(regexp_replace({c}, '[\"''<>]', '', 'g'), '\\s+', ' ', 'g')), '')"


@query(f"WITH m AS ({R.SQL['main_text']}), t AS ({R.SQL['page_tags']}), parts AS (SELECT entity_id, {_FLAT.format(c=_CLEANED.format(c='title'))} AS a, {_FLAT.format(c=_CLEANED.format(c='description'))} AS b, "
       f"array_to_string(list_filter(string_split(main, ' '), lambda w: {R.KEEP.format(w='w')}), ' ') AS c, {_FLAT.format(c='t.tags')} AS d FROM entities JOIN m USING (entity_id) JOIN t USING (entity_id)) "
       "SELECT entity_id, trim(regexp_replace(a || ' ' || b || ' ' || c || ' ' || d, ' +', ' ', 'g')) AS text FROM parts")
def document_texts(spark, root):
    """The text of each page for the index: title, description, kept words of the article, tags."""
    a = pages.attributes(F.col("html"))
    x = R._html(spark, root).select("entity_id", a["title"].alias("title"), a["description"].alias("description"), a["tags"].alias("tags"), pages.main_text(F.col("html")).alias("main"))
    text = pages.document_text(F.col("title"), F.col("description"), F.col("main"), F.col("tags"), (*N.TEXT_STOP_WORDS, *N.ENGLISH_STOP_WORDS))
    return x.select("entity_id", F.trim(F.regexp_replace(text, " +", " ")).alias("text"))


# wiki --------------------------------------------------------------------------------------------

#: (markup before a value, markup behind it, text before, text behind): one or more for each rule of value cleaning.
CASES = [
    ("", "\n|", "", ""), ("", "\n\nb", "", " b"), ("{{start date|df=y|2020|4|26}} ", "", "2020-4-26 ", ""), ("{{end date|2020|4}} ", "", "2020-4 ", ""), ("{{Start date|2020|May|5}} ", "", "2020-5 ", ""), ("{{start date|2020}} ", "", "2020 ", ""),
    ("<ref name=\"x\" />", "<ref>{{cite web|url=x}}</ref>", "", ""), ("{{cite web|title=x}}", "", "", ""), ("{{nowrap|", "}}", "", ""), ("{{abbr|", "|long form}}", "", ""), ("{{ill|", "|ko|x}}", "", ""), ("'''", "''' ''z''", "", " z"),
    ("{{small|", "}}", "", ""), ("{{unreliable source?|date=x}}", "", "", ""), ("{{lang|ko|x}}", "", "", ""), ("{{Korean/auto|hangul=x}}", "{{ko-h|x}}", "", ""), ("", "{{efn|note}}", "", ""), ("[[Target|", "]]", "", ""), ("[[", "]], [[B|C]]", "", ", C"),
    ("[[File:a.jpg|thumb]]", "", "", ""), ("{{interlanguage link|", "|ko|x}}", "", ""), ("{{Based on|Book|", "}}", "Book by ", ""), ("{{KRW|9 billion}} ", "", "9 billion KRW ", ""), ("{{SK won|3}} ", "", "3 SK WON ", ""), ("{{USD|5 million}} ", "", "5 million USD ", ""),
    ("<!-- x -->", "", "", ""), ("{{ubl|", "|B}}", "", ", B"), ("{{plainlist|\n* ", "\n* B\n}}", "", ", B"), ("{{hlist|", "|B}}", "", ", B"), ("{{theme song|", "|B}}", "", ", B"), ("{{hidden|a|b}}", "", "", ""), ("* ", "\n* B", "", ", B"), ("", "<br />B", "", ", B"),
    ("", " ()", "", ""), ("{{unknown|x}}", "", "", ""), ("", "}}", "", ""), ("<b>", "</b>", "", ""), ("===Head=== ", "", "", ""), ("", " |key= C", "", " C"), ("", "|B", "", ", B"), ("", " = B", "", " B"), ("&lt;i&gt;", "&lt;/i&gt;&nbsp;&amp; B", "", " & B"),
]
_PLAIN = "trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _plain(c: str):
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^A-Za-z0-9 ]", " "), " +", " "))


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _case_sql(cases) -> str:
    return "c(i, p, q) AS (VALUES " + ", ".join(f"({i}, {_quoted(x[2])}, {_quoted(x[3])})" for i, x in enumerate(cases)) + f"), v AS (SELECT rec_id, {_PLAIN.format(c='title')} AS v FROM {WIKI})"


def _case_rows(spark, root, cases):
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x[0]).alias("before"), F.lit(x[1]).alias("behind")) for i, x in enumerate(cases)])
    x = table(spark, root, WIKI).select("rec_id", _plain("title").alias("v")).where("v <> ''").select("rec_id", "v", F.explode(rows).alias("c"))
    return x.select("rec_id", F.col("c.i").alias("i"), F.concat("c.before", "v", "c.behind").alias("raw"))


@query(f"WITH {_case_sql(CASES)} SELECT rec_id, i, p || v || q AS cleaned FROM v, c WHERE v <> ''")
def wiki_clean(spark, root):
    """Values inside every kind of wiki markup, cleaned."""
    x = _case_rows(spark, root, CASES).withColumn("cleaned", F.transform(F.array("raw"), wikitext.clean_value)[0])
    return x.select("rec_id", "i", "cleaned")


#: The same for character references.
REFERENCES = [("&amp;", "&lt;b&gt;", "&", "<b>"), ("&#65;", "&#x42;", "A", "B"), ("&quot;", "&quot;", '"', '"'), ("&eacute;", "&Omega;&hellip;", "é", "Ω…"), ("&amp;amp;", "", "&amp;", ""), ("&unknown;", "& x; AT&T", "&unknown;", "& x; AT&T"), ("&#128512;", "&apos;", "😀", "'")]


@query(f"WITH {_case_sql(REFERENCES)} SELECT rec_id, i, p || v || q AS native, p || v || q AS full5 FROM v, c WHERE v <> ''")
def decode_entities(spark, root):
    """Character references decoded natively and by the function with all HTML 5 names."""
    return _case_rows(spark, root, REFERENCES).select("rec_id", "i", decode_char_refs(F.col("raw")).alias("native"), decode_udf(F.col("raw")).alias("full5"))


_ATTR = "CASE WHEN {v} = '' THEN '' WHEN rec_id % 5 = 3 THEN {v} || ' & Z' WHEN rec_id % 5 = 4 THEN {v} || ', B' ELSE {v} END"


@query(f"SELECT coalesce(wiki_id, '') AS wiki_id, {_PLAIN.format(c='title')} AS title, coalesce(timestamp, '') AS timestamp, {_PLAIN.format(c='username')} AS username, "
       + ", ".join(f"{_ATTR.format(v=_PLAIN.format(c=c))} AS {c}" for c in wikitext.ATTRIBUTES) + f", {_PLAIN.format(c='synopsis')} AS synopsis FROM {WIKI} WHERE contains(lower({_PLAIN.format(c='country')}), 'south korea') AND contains(lower({_PLAIN.format(c='language')}), 'korean')")
def wiki_dump_records(spark, root):
    """All 29 columns of the records of a dump: pages as they stand in one, encoded twice, with all keys and ends of boxes taking turns."""
    k = F.col("rec_id")

    def line(c: str):
        keys = wikitext.ATTRIBUTES[c]
        value = let(_plain(c), lambda v: F.when(v == "", "").when(k % 5 == 1, F.concat(F.lit("[[Link|"), v, F.lit("]]"))).when(k % 5 == 2, F.concat(F.lit("'''"), v, F.lit("'''&lt;ref name=x&gt;n&lt;/ref&gt;")))
                    .when(k % 5 == 3, F.concat(v, F.lit("&amp;nbsp;&amp;amp; Z"))).when(k % 5 == 4, F.concat(F.lit("{{ubl|"), v, F.lit("|B}}"))).otherwise(v))
        return F.concat(F.lit("| "), F.get(F.array(*map(F.lit, keys)), (k % len(keys)).cast("int")), F.lit(" = "), value, F.lit("\n"))

    end = F.when(k % 3 == 0, "}}\nText\n\n").when(k % 3 == 1, "}}{{Unreliable sources|x}}\n\n").otherwise("}}'\n\n")
    text = F.concat(F.lit("{{Infobox television\n"), *[line(c) for c in wikitext.ATTRIBUTES], end, F.when(k % 2 == 0, "== Plot ==\n").otherwise("== Synopsis ==\n"), _plain("synopsis"), F.lit("\n== Cast ==\n* A"))
    page = F.concat(F.lit("  <page>\n<title>"), _plain("title"), F.lit("</title>\n<id>"), F.coalesce("wiki_id", F.lit("")), F.lit("</id>\n<revision><id>9</id><timestamp>"), F.coalesce("timestamp", F.lit("")),
                    F.lit("</timestamp><contributor><username>"), _plain("username"), F.lit('</username></contributor><text xml:space="preserve">'), text, F.lit("</text></revision>"))
    # written once, as a dump is
    return wikitext.records(wikitext.page_parts(cut(table(spark, root, WIKI).select(page.alias("value")))))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
