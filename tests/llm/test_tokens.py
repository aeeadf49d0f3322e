import os
import random

import pytest

from lexiloom.llm.bpe import DEFAULT_TOKENIZER, PrefixEncoder, encode, read_vocabulary
from lexiloom.llm.languages import language_code
from lexiloom.llm.maxmatch import MaxMatchTrie
from lexiloom.llm.token_budget import document_tokens, totals
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no tokenizer")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_exact_ids(reference):
    e = PrefixEncoder(read_vocabulary())
    rnd = random.Random(3)
    signs = "aaabbeeesstttiinn     \n\t\r\x1c\x1f\x85\xa0​　가나한국のは日éüß0123456789.,!?'\"-_<>|#😀👩‍👧ª²½Ⅷ"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 20000, "ab" * 9000, " " * 5000, "<|endoftext|> x", "하" * 3000, "it's we'll  x ", ""]
    for s in texts:
        assert e.ids(s) == reference(s)


def test_encode(spark, reference):
    df = spark.createDataFrame([(1, "Hello wide world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello wide world", "x"), (4, " \n", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode(df, "doc_id", "text").collect())
    assert got == [(1, reference("Hello wide world"))] * 2 + [(2, []), (3, []), (4, reference(" \n"))]
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def greedy(first, inner, w):
    n = i = 0
    while i < len(w):
        words = first if i == 0 else inner
        j = next((j for j in range(len(w), i, -1) if w[i:j] in words), None)
        if j is None:
            return None
        n, i = n + 1, j
    return n


def test_longest_match_against_brute_force():
    rnd = random.Random(5)
    make = lambda: {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 8))}
    for _ in range(5000):
        first, inner, w = make(), make(), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
        if rnd.random() < 0.5:
            first, inner = first | set("abc"), inner | set("abc")
        assert MaxMatchTrie(first, inner).count(w) == greedy(first, inner, w)


def test_budget(spark, reference):
    documents = spark.createDataFrame([(1, "one two", "EN", "a.example"), (2, "하나", "kor", None), (3, None, "und", "www.A.example"), (4, "one two", None, "b.example")], "doc_id bigint, text string, lang string, source string")
    docs = spark.createDataFrame([(1, "http://www.A.example/", "a.example/x.txt", 2), (1, "a.example", "a.example/x.txt", 2), (1, "b", "x", -5), (2, None, "b.example/y.txt", 9), (9, "a", "p", 1)], "doc_id bigint, site string, path string, length bigint")
    sites = spark.createDataFrame([("a.example",), ("b.example",)], "domain string")
    rows = {r.doc_id: r for r in document_tokens(documents, docs, sites).collect()}
    assert [(rows[i].site, rows[i].lang, rows[i].source, rows[i].words) for i in (1, 2, 3, 4)] == [("a.example", "en", "a.example", 2), ("b.example", "ko", "unknown", 9), ("unknown", "unknown", "a.example", None), ("unknown", "unknown", "b.example", None)]
    assert [rows[i].tokens for i in (1, 2, 3)] == [len(reference("one two")), len(reference("하나")), 0]
    t = {(r["slice"], r["value"]): (r.documents, r.tokens) for r in totals(document_tokens(documents, docs, sites)).collect()}
    assert t["all", "all"] == (4, 2 * len(reference("one two")) + len(reference("하나"))) and t["lang", "en"] == (1, len(reference("one two")))


def test_labels(spark):
    cases = {"EN": "en", "eng": "en", "en-US": "en", "English": "en", "ja_JP": "ja", "Indonesian": "id", "ind": "id", " Korean ": "ko", "und": None, "unknown": None, "": None, None: None, "pt-BR": "pt"}
    got = spark.createDataFrame([(k,) for k in cases], "l string").select(language_code(F.col("l")).alias("c")).collect()
    assert [r.c for r in got] == list(cases.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_globals_have_five_rows(spark):
    from lexiloom.llm import queries

    got = {r.name: r.value for r in queries.p6_globals(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"documents", "words", "sites", "vocabulary", "tokens"} and got["tokens"] == sum(r.tokens for r in queries.p6_documents(spark, "/root/testdata/sf0.001").collect())
