import glob
import os

import duckdb
import pytest

from lexiloom.functions import normalise as N
from lexiloom.operators import crawl, index, linking, pages, wikitext
from lexiloom.plans import extended, reference
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def cell(v):
    return None if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(reference.oracle_sql() | extended.oracle_sql()))
def test_sql(spark, duck, name):
    df = (reference.queries() | extended.queries())[name](spark, DATA)
    rel = duck.sql((reference.oracle_sql() | extended.oracle_sql())[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(cell(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_links(spark):
    html = ("<a href='/a/?x=1#y'>1</a><a href=\"b/../c\">2</a><a HREF=\"https:/h.example/d\">3</a><a href='//h.example/e/'>4</a><a href='http://o.example/f'>5</a>"
            "<a href='/login'>6</a><a href='/x.png?1'>7</a><a href='/tag/q/'>8</a><a href='/page/11/'>9</a><a href='/page/10/'>10</a><a href='/'>11</a><a href='/a#z'>12</a>")
    df = spark.createDataFrame([("https://h.example/dir/p", html), ("https://h.example/empty", None)], "url string, html string")
    got = {r.dst for r in pages.links(df, {"h.example": 10}).collect()}
    assert got == {"https://h.example/" + p for p in ("a", "dir/c", "d", "e", "page/10", "")}


def test_attributes(spark):
    html = ('<title> A\n B </title><span class="author vcard"> <a href="x">Jo <</a></span><time class="entry-date published" datetime="2020-01-01">x</time><meta content="D" name="description">'
            '<meta property="og:url" content="https://h.example/shows/x"><section class="banner-recap-detail"><a class="post_tags">In</a><a rel="tag">In</a><a rel="tag">y</a></section><a rel="tag">Out</a>')
    a = pages.attributes(F.col("html"))
    r = spark.createDataFrame([(html,)], "html string").select(*[c.alias(n) for n, c in a.items()]).first()
    assert (r.title, r.author, r.date, r.description, r.url, r.tags) == ("A B", "Jo", "2020-01-01", "D", "https://h.example/shows/x", ["In"])


def test_number_words(spark):
    words = "0 00 01 09 50 51 99 007 100 1879 1880 2030 2031 01990".split()
    df = spark.createDataFrame([(w,) for w in words], "w string").where(N.keep_word(F.col("w"), ()))
    assert [r.w for r in df.collect()] == "01 09 50 1880 2030 01990".split()


def test_crawl_free_pages(spark):
    e = spark.createDataFrame([("a", "h/page/2"), ("h/page/2", "h/page/3"), ("h/page/3", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {(r.url, r.depth) for r in crawl.crawl(spark.createDataFrame([("a",)], "url string"), e, 1).collect()}
    assert got == {("a", 0), ("h/page/2", 0), ("h/page/3", 0), ("b", 1)}
    assert crawl.crawl(spark.createDataFrame([("a",)], "url string"), e, 9, 3).count() == 3


def test_phrase_join_equals_containment(spark):
    import random

    rnd = random.Random(4)
    titles = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    names = sorted({" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) for _ in range(60)})
    p = spark.createDataFrame([(str(i), t, []) for i, t in enumerate(titles)], "url string, title_clean string, tags_clean array<string>")
    n = spark.createDataFrame([(str(i), x) for i, x in enumerate(names)], "wiki_id string, name string")
    for most in (12, 2):
        df = linking.match_phrase(p, n, most)
        got = {(r.url, r.name) for r in df.collect()}
        assert got == {(str(i), x) for i, t in enumerate(titles) for x in names if f" {x} " in f" {t} "}
    plan = linking.match_phrase(p, n)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tfidf_repeats_and_unknown(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, None), (4, "  ")], "doc_id bigint, text string")
    c = index.term_counts(d)
    v = {r.term: (r.df, r.idf_ordinary) for r in index.vocabulary(c).collect()}
    assert v["a"] == (2, 0.0) and v["b"][0] == 1
    one, two = (index.search(d, q).collect() for q in (["b"], ["b", "b", "zz"]))
    assert round(one[0].score * 2, 5) == round(two[0].score, 5)


def test_wiki_values(spark):
    cases = {"{{start date|2020|4|26|df=y}}": "2020-4-26", "{{Start date|2020|4}}": "2020-4", "[[A|B]], ''C''": "B, C", "{{KRW|9 billion}}": "9 billion KRW", "{{SK won|3}} x": "3 SK WON x", "{{plainlist|\n* A\n* B\n}}": "A, B", "{{ubl|A|B}}": "A, B",
             "A<br />B<ref>z</ref>": "A, B", "A {{unknown|x}} ()": "A", "<!-- c -->A &amp; B": "A & B", None: "", "": ""}
    keys = list(cases)
    got = spark.createDataFrame([(k,) for k in keys], "v string").select(wikitext.clean_value(F.col("v")).alias("c")).collect()
    assert dict(zip(keys, [r.c for r in got])) == cases


def test_dump_splits(spark, tmp_path):
    page = "<page><title>T{0}</title><id>{0}</id><revision><id>9</id><timestamp>t</timestamp><contributor><username>u</username></contributor><text>{{{{Infobox television\n| country = [[South Korea]]\n| language = Korean\n| written_by = W{0}\n}}}}\n\n== Plot ==\nP{0}\n== Cast ==\nx</text></revision></page>\n"
    (tmp_path / "d.xml").write_text("<mediawiki>\n" + "".join(page.format(i) for i in range(300)) + "</mediawiki>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = wikitext.read_dump(spark, str(tmp_path / "d.xml"))
        assert raw.rdd.getNumPartitions() > 5
        r = {x.wiki_id: x for x in wikitext.records(wikitext.page_parts(raw)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(r) == 300 and r["7"].writer == "W7" and r["7"].synopsis == "P7" and r["7"].country == "South Korea" and len(r["7"]) == 29


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_joined_search_has_all_matchable_fields(spark):
    q = reference.queries()
    fields = {r.field for r in q["joined_field_statistics"](spark, DATA).collect()}
    assert {"title", "tags", "wiki_title", "based_on", "producer", "executive_producer", "num_episodes", "num_seasons", "first_aired_year", "last_aired_year"} <= fields
    assert len(reference.JOINED) + len(reference.JOINED_EXACT) == 22
    assert q["bm25_joined"](spark, DATA).count() == 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_attributes_come_back_from_the_infobox(spark):
    names = list(wikitext.ATTRIBUTES)
    wiki = spark.read.parquet(f"{DATA}/{reference.WIKI}.parquet")
    want = {r[0]: r[1:] for r in wiki.select("rec_id", F.transform(F.array(*names), wikitext.clean_value).alias("v")).select("rec_id", *[F.get("v", i) for i in range(len(names))]).collect()}
    got = reference.queries()["wiki_infobox_all"](spark, DATA)
    assert len(names) == 24 and got.columns == ["rec_id", *names]
    assert {r[0]: r[1:] for r in got.collect()} == want
    records = reference.queries()["wiki_records"](spark, DATA)
    assert len(records.columns) == 29 and records.count() == reference.queries()["wiki_qualify"](spark, DATA).count()


def test_steps_in_paths_at_any_depth(spark):
    cases = {"https://h.example/a/b/../c": "https://h.example/a/c", "https://h.example/a/b/c/d/e/f/../../../../../g": "https://h.example/a/g", "https://h.example/../../x/./y?q=../z": "https://h.example/x/y?q=../z",
             "https://h.example/a/..": "https://h.example/", "https://h.example/a.b/c..d": "https://h.example/a.b/c..d", "https://h.example": "https://h.example", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r.x for r in df.select(pages.undotted(F.col("u")).alias("x")).collect()] == list(cases.values())


def test_page_rules(spark):
    rows = [("a_com.html", 900, "a", "x", "root"), ("www_a_com_2_1.html", 900, "a", "x", "root"), ("index.html", 900, "a", "x", "root"), ("a_com_show.html", 900, "a", "x", None), ("a_com_show.html", 499, "a", "x", "small"), ("a_org.html", 900, "a", "x", None),
            ("a_news.html", 900, "a", "x", "phrase"), ("a_news.html", 900, "b", "x", None), ("b_x.html", 900, "c", "nothing", "topic"), ("b_x.html", 900, "c", "a K-Drama page", None), ("b_x.html", 900, "c", None, "topic"), (None, 900, "c", "k-drama", None)]
    df = spark.createDataFrame(rows, "name string, size int, site string, html string, want string")
    got = df.select("want", pages.skip_reason(F.col("name"), F.col("size"), {"a": ("news",)}, 500, F.col("site"), F.col("html"), {"c": ("k-drama",)}).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    types = spark.createDataFrame([(200, "Text/HTML; charset=x"), (200, "image/png"), (404, "text/html"), (200, None), (None, "text/html")], "status int, kind string")
    assert [r.ok for r in types.select(pages.is_html(F.col("status"), F.col("kind")).alias("ok")).collect()] == [True, False, False, False, False]


def test_longest_robots_rule_decides(spark):
    rules = spark.createDataFrame([("h.example", "/a", False), ("h.example", "/a/b", True), ("h.example", "/a/b/c", False), ("h.example", "/x", False), ("h.example", "/x", True)], "host string, prefix string, allow boolean")
    urls = spark.createDataFrame([(f"https://h.example{p}",) for p in ("", "/a/z", "/a/b/z", "/a/b/c/z", "/x/1")] + [("https://o.example/a",)], "url string")
    assert {r.url for r in pages.robots_allowed(urls, rules).collect()} == {"https://h.example", "https://h.example/a/b/z", "https://h.example/x/1", "https://o.example/a"}


def test_stored_index_reads_only_the_asked_terms(spark, tmp_path):
    rows = [(1, "Red lamp", "ab", "1"), (2, "Blue lamp lamp", None, "2"), (3, "", "  ", None), (4, None, "lamp", "1"), (5, "Red lamp", "ab", "1")]
    df = spark.createDataFrame(rows, "k bigint, title string, alt string, seasons string")
    path = str(tmp_path / "index")
    index.store_fields(df, "k", path, ("title", "alt"), ("seasons",), ("alt",))
    got = index.search_index(spark, path, "k", ["lamp", "1", "zz"])
    want = index.search_fields(index.field_terms(df, "k", ("title", "alt"), ("seasons",)), "k", ["lamp", "1", "zz"])
    assert got.collect() == want.collect() and got.count() == 4
    plan = index.search_index(spark, path, "k", ["lamp"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,lamp)" in plan
    shown = {(r.field, r.value) for r in index.stored_rows(spark, path, got.where("k = 2"), "k", ("alt",)).collect()}
    assert shown == {("title", "Blue lamp lamp"), ("seasons", "2")}
    assert index.search_index(spark, path, "k", ["nothing"]).count() == 0 and index.search_index(spark, path, "k", []).count() == 0


def test_search_drops_stop_words(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b"), (3, None)], "doc_id bigint, text string")
    assert [r.doc_id for r in index.search(d, ["a", "b"], stop_words=("b",)).collect()] == [1]
    assert index.search(d, ["b"], stop_words=("b",)).count() == 0


def test_postings_blocks_hold_every_posting(spark):
    d = spark.createDataFrame([(i, "x y" if i % 2 else "x") for i in range(50)], "doc_id bigint, text string")
    b = index.postings_blocks(index.term_counts(d), 16).collect()
    assert sorted(i for r in b if r.term == "x" for i in r.ids) == list(range(50)) and max(len(r.ids) for r in b) <= 16
    assert {r.term: r.doc_freq for r in index.postings(index.term_counts(d)).collect()} == {"x": 50, "y": 25}


def test_linked_rows_have_all_columns(spark):
    e = spark.createDataFrame([(1, "f", "d.example", "Quiet\tLamp: Episode 1", None, None, "a\r\nb", "https://d.example/1", ["quiet lamp", "x"]), (2, "f", "d.example", "Quiet\tLamp: Episode 1", "later", None, None, "https://d.example/1", None), (3, "g", None, None, None, None, None, None, None)],
                              "entity_id bigint, file string, domain string, title string, author string, date string, description string, url string, tags array<string>")
    cols = ["title", "timestamp", "username", *wikitext.ATTRIBUTES, "synopsis"]
    w = spark.createDataFrame([(1, "w1", "Quiet Lamp (2016)", "2020", "u", *["v\n1"] * 24, None), (2, "w1", "Quiet Lamp (2016)", "2021", "u", *["v\n2"] * 24, "s")], "rec_id bigint, wiki_id string, " + ", ".join(f"{c} string" for c in cols))
    x = linking.attach(linking.link(e, w), e, w)
    assert len(x.columns) == 40 and x.columns == list(linking.OUTPUT)
    r = [r for r in x.collect() if r.match_type == "title"][0]
    assert (r.title, r.description, r.tags, r.writer, r.synopsis, r.wiki_title_clean, r.author) == ("Quiet Lamp: Episode 1", "a b", "quiet lamp|x", "v 2", "s", "quiet lamp", None)


def test_dump_text_is_decoded_twice(spark):
    page = "<page><title>T</title><id>1</id><revision><timestamp>t</timestamp><contributor><username>u</username></contributor><text>{{Infobox television\n| country = South Korea\n| language = Korean\n| writer = A&amp;nbsp;B &amp;amp; C\n| network = N\n}}{{Unreliable sources}}\n== Plot ==\nP</text></revision>"
    r = wikitext.records(wikitext.page_parts(spark.createDataFrame([(page,)], "value string"))).first()
    assert r.writer == "A B & C" and r.network == "N" and r.synopsis == "P"
