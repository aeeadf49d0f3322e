import json

from lexiloom.sources import readers, writers
from lexiloom.streaming import pages as stream


def test_round_trips(spark, tmp_path):
    (tmp_path / "h" / "a.example").mkdir(parents=True)
    (tmp_path / "h" / "a.example" / "x.html").write_bytes(b"<title>A</title>\xff")
    (tmp_path / "h" / "a.example" / "y.HTML").write_text("no")
    (tmp_path / "h" / "a.example" / "t.txt").write_text("Two\nLines")
    (tmp_path / "h" / "a.example" / "robots.txt").write_text("User-agent: *\nDisallow: /tag\n")
    root = str(tmp_path / "h")
    r = readers.html_files(spark, root).collect()
    assert len(r) == 1 and r[0].size == 17 and r[0].html.startswith("<title>A")
    t = {x.site: x.text for x in readers.text_files(spark, root).where("path like '%t.txt'").collect()}
    assert t == {"a.example": "two\nlines"}
    assert [tuple(x) for x in readers.robots_rules(spark, root).collect()] == [("a.example", "/tag", False)]
    (tmp_path / "e.jsonl").write_text('{"file": "f", "title": "1", "tags": ["a"]}\nnot json\n{"file": "f", "title": "2"}\n')
    e = readers.entity_lines(spark, str(tmp_path / "e.jsonl")).where("file is not null")
    assert sorted(x.title for x in e.collect()) == ["1", "2"]
    df = spark.createDataFrame([("b", 2, 0.5, 0.1), ("a", 1, 0.2, 0.3)], readers.VOCAB_SCHEMA)
    writers.tsv(df, str(tmp_path / "v"), "term")
    assert sorted(readers.tsv(spark, str(tmp_path / "v"), readers.VOCAB_SCHEMA).collect()) == sorted(df.collect())
    p = spark.createDataFrame([("a", 2, "(1:1.000000), (5:1.693147)")], "term string, doc_freq bigint, postings string")
    writers.tsv(p, str(tmp_path / "p"), "term")
    assert [(x.doc_id, x.tf) for x in readers.postings(spark, str(tmp_path / "p")).collect()] == [(1, 1.0), (5, 1.693147)]
    writers.pages(spark.createDataFrame([("d1", "u1", "h"), ("d2", "u2", "h")], "domain string, url string, html string"), str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).where("domain = 'd1'").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"file": str(i), "title": f"It's  {i}!"}) for i in range(3)))
    q = stream.titles(stream.entity_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("titles").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.title_clean for r in spark.table("titles").collect()) == ["its 0", "its 1", "its 2"]


def test_robots_groups():
    text = "# all\nUser-agent: nosy\nDisallow: /\n\nUser-agent: *\nUser-agent: other\nDisallow: /tag # no tags\nAllow: /tag/good\nDisallow:\n\nSitemap: https://x\nUser-agent: late\nDisallow: /late\n"
    assert readers._rules_of(text, "*") == [(False, "/tag"), (True, "/tag/good")] == readers._rules_of(text, "unknown")
    assert readers._rules_of(text, "Nosy") == [(False, "/")] and readers._rules_of(text, "late") == [(False, "/late")]
    assert readers._rules_of("", "*") == [] and readers._rules_of("Disallow: /x", "*") == []


def test_sinks_overwrite_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1), (None, 2)], "text string, n int")
    for _ in range(2):
        writers.texts(df, str(tmp_path / "t"))
        writers.parquet(df, str(tmp_path / "p"))
        writers.json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["", "a b"]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.json(str(tmp_path / "j")).count() == 2
    log = spark.createDataFrame([("u", 200, "f", 1, 0, "2020")], readers.PAGE_LOG_SCHEMA)
    for _ in range(2):
        writers.append_log(log, str(tmp_path / "l"))
    assert readers.tsv(spark, str(tmp_path / "l"), readers.PAGE_LOG_SCHEMA).count() == 2
    (tmp_path / "x.html").write_text("<p>a &amp; b</p>")
    assert [r.html for r in readers.html_files(spark, str(tmp_path), decode=True).collect()] == ["<p>a & b</p>"]


def test_registered_functions(spark):
    from lexiloom.functions.register import register
    from lexiloom.operators import index

    d = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "c")], "doc_id bigint, text string")
    index.term_counts(d).createOrReplaceTempView("tfidf_counts")
    register(spark)
    r = spark.sql("select strip_html('<p>a<script>x</script>  b<br/></p>') s, strip_html(null) n, decode_entities('a&amp;b') d").first()
    assert (r.s, r.n, r.d) == ("a b", None, "a&b")
    assert [(x.doc_id, x.score) for x in spark.sql("select doc_id, score from tfidf_search('A b a', 2)").collect()] == [(x.doc_id, x.score) for x in index.search(d, ["a", "b", "a"], k=2).collect()]


def test_a_cluster_without_shared_folder_fails():
    from types import SimpleNamespace

    import pytest

    from lexiloom.runtime import ensure_checkpoint_dir

    made = []
    fake = lambda master, named: SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=made.append), conf=SimpleNamespace(get=lambda k, d: named))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(fake("spark://h:7077", None))
    ensure_checkpoint_dir(fake("spark://h:7077", "hdfs://x"))
    ensure_checkpoint_dir(fake("local[4]", None))
    assert made[0] == "hdfs://x" and len(made) == 2
