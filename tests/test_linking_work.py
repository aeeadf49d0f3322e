"""Many pages and many records of one name: results equal SQL, and the work grows with both, not with their product."""

import duckdb
import pytest

from lexiloom.operators import wikitext
from lexiloom.plans import extended, reference

N = 300


@pytest.fixture(scope="module")
def hello(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hello"))
    pages = [(i, f"f{i}", "d.example", f"Hello lamp {i % 100}", "a", "d", "s", None if i % 50 == 0 else f"https://d.example/{i:04d}", [["lamp"], ["Lamp 7", "x"], None][i % 3]) for i in range(N)]
    spark.createDataFrame(pages, "entity_id bigint, file string, domain string, title string, author string, date string, description string, url string, tags array<string>").write.parquet(f"{root}/entities.parquet")
    cols = ["title", "timestamp", "username", *wikitext.ATTRIBUTES, "synopsis"]
    value = lambda c, i: {"title": "Lamp (2016)" if i % 2 else f"Lamp {i}", "alt_name": f"Hello, Other {i}", "timestamp": "2020", "language": "Korean", "first_aired": "2016"}.get(c, f"v {c} {i}")
    records = [(i, None if i < 2 else f"w{i:04d}", *[value(c, i) for c in cols]) for i in range(N)]
    spark.createDataFrame(records, "rec_id bigint, wiki_id string, " + ", ".join(f"{c} string" for c in cols)).write.parquet(f"{root}/{reference.WIKI}.parquet")
    return root


def most(plan, metric):
    """The largest value of a metric in a plan that ran."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    m = plan.metrics().get(metric)
    return max([m.get().value() if m.isDefined() else 0, *[most(p, metric) for p in (*inner, *[children.apply(i) for i in range(children.size())])]])


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


def check(spark, root, name, metric):
    df = (reference.queries() | extended.queries())[name](spark, root)
    got = df.collect()
    duck = duckdb.connect()
    for t in ("entities", reference.WIKI):
        duck.execute(f"create view {t} as select * from '{root}/{t}.parquet/*.parquet'")
    rel = duck.sql((reference.oracle_sql() | extended.oracle_sql())[name])
    assert sorted(map(repr, (tuple(cell(r[c]) for c in rel.columns) for r in got))) == sorted(map(repr, (tuple(map(cell, r)) for r in rel.fetchall())))
    assert most(df._jdf.queryExecution().executedPlan(), metric) < N * N / 3
    return got


def test_best_match(spark, hello):
    got = check(spark, hello, "link_best_match", "numOutputRows")
    assert len(got) == 100


def test_full(spark, hello):
    got = check(spark, hello, "link_full", "numOutputRows")
    assert {r.match_type for r in got} == {"title", "alt", "tag"} and {r.wiki_id for r in got if r.match_type == "alt"} == {"w0002"}


def test_report(spark, hello):
    check(spark, hello, "link_report", "numOutputRows")


def test_output(spark, hello):
    check(spark, hello, "link_output", "numOutputRows")


def test_all_pairs_are_not_shuffled(spark, hello):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(check(spark, hello, "link_by_alt", "shuffleRecordsWritten")) > N * N / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joined_statistics(spark, hello):
    check(spark, hello, "joined_field_statistics", "numOutputRows")


def test_joined_search(spark, hello):
    got = check(spark, hello, "bm25_joined", "numOutputRows")
    assert len(got) == 10
    parts = reference._joined_fields(spark, hello, ("korean", "korean", "nothing"))
    terms = {(r.field, r.len, tuple(r.asked)) for r in parts.collect() if r.field in ("language", "title")}
    assert terms == {("language", 1, ("korean",)), ("title", 3, ())}
    assert most(parts._jdf.queryExecution().executedPlan(), "numOutputRows") < N * N / 3
