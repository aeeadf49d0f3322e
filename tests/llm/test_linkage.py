import random

import numpy as np

from pyspark.sql import functions as F

from lexiloom.llm.linkage import _project, framed_name, induce_frames, link, page_titles, solve


def test_projection():
    rnd = np.random.default_rng(1)
    v, block = rnd.normal(size=30), np.repeat(np.arange(6), 5)
    p = _project(v, block, 6)
    for b in range(6):
        x, y = v[block == b], p[block == b]
        assert y.min() >= 0 and y.sum() <= 1 + 1e-6
        for _ in range(200):
            z = np.abs(rnd.normal(size=5))
            z = z / max(1, z.sum())
            assert ((x - y) ** 2).sum() <= ((x - z) ** 2).sum() + 1e-6


def test_link(spark):
    wiki = spark.createDataFrame([
        (1, "w1", "Quiet Lamp, Tide (2013 TV series)", "수리 롱마 / Suri Rongma", "2013-1-1"), (2, "w2", "Quiet Lamp, Tide (2016 TV series)", None, "2016"), (3, "w2", "Quiet Lamp, Tide (2016 TV series)", None, "2016"),
        (4, "w3", "Harbor of the Silver Moth", '"Damro Biga"', None), (5, "w4", None, " ", None), (6, None, "No Id", None, None)], "rec_id bigint, wiki_id string, title string, alt_name string, first_aired string")
    p = [("[Recap] Harbor of the Silver Moth ep 3 | Bean Lantern", None), ("Watch HARBOR-OF-THE-SILVER-MOTH E5", []), ("Harbor of the Slver Moth 1x03", []), ("Harbor of the Silver M… – Ep. 04", ["harbor-of-the-silver-moth", "romance"]),
         ("Review: Quiet Lamp, Tide (2016)", []), ("Quiet Lamp, Tide finale: what happened?", ["2013 drama"]), ("Quiet Lamp, Tide: Episode 2", ["Suri Rongma"]), ("Quiet Lamp, Tide: Episode 2", ["x"]), ("Better than Harbor of the Silver Moth? Our 5 picks", []),
         ("Ratings, week 3", ["Damro Biga", None, ""]), ("Unknown Show: Episode 1", ["romance"]), (None, None), ("", []), ("Watch Damro Bigo E2", ["Damro Bigo"])]
    learn = ["[Recap] {} ep 4", "Watch {} E7", "{} 1x02", "{} – Ep. 03", "Review: {}", "{} finale: what happened?", "{}: Episode 9"]
    p += [(f.format(f"Zo{'abcd'[k]} Pim"), [f"zo{'abcd'[k]} pim"]) for f in learn for k in range(4)]
    pages = spark.createDataFrame([(i, t, g, "beanlantern.example", None, f"beanlantern_{i}.html", "w9") for i, (t, g) in enumerate(p)],
                                  "entity_id bigint, title string, tags array<string>, domain string, url string, file string, wiki_id string")
    sites = spark.createDataFrame([("beanlantern.example", "Bean Lantern")], "domain string, site_name string")
    got = {r.entity_id: r.wiki_id for r in link(pages, wiki, sites).collect()}
    assert got == {0: "w3", 1: "w3", 2: "w3", 3: "w3", 4: "w2", 5: "w1", 6: "w1", 9: "w3"}
    assert link(pages.limit(0), wiki, sites).count() == 0
    assert link(pages, wiki.limit(0), sites).count() == 0


FILL = ["Watch {} E{}", "{}: Episode {}", "[Recap] {} ep {}", "{} finale: what happened?", "Review: {}", "Jo Ann joins {}"]
#: Titles of a site whose ways of framing no other site has.
UNSEEN = ["Chapter {1} of {0} // thoughts", "{0} in {1} pictures", "Sofa talk » {0}"]
COMPARE = "{1} dramas to watch if you liked {0}"


def _site_pages(n):
    """Pages of two sites on n shows each; half of the pages have their show among the tags, pages that compare have it never."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(3)).capitalize()
    shows = [f"{word()} {word()} {word()}" for _ in range(2 * n)]
    pages, want, compared = [], {}, []
    for i in range(20 * n):
        site, frames = (("old.example", FILL), ("new.example", UNSEEN))[i % 2]
        k = rnd.randrange(2 * n)
        title = frames[i // 2 % len(frames)].format(shows[k], rnd.randint(1, 20))
        pages.append((i, title, [shows[k].lower().replace(" ", "-"), "romance"] if rnd.random() < 0.5 else ["romance"], site, None, "f"))
        want[i] = f"w{k}"
    for i in range(20 * n, 24 * n):
        pages.append((i, COMPARE.format(rnd.choice(shows), rnd.randint(3, 9)), ["romance"], ("old.example", "new.example")[i % 2], None, "f"))
        compared.append(i)
    return shows, pages, want, compared


def test_frames_of_a_site_nobody_has_seen(spark):
    shows, pages, want, compared = _site_pages(40)
    df = spark.createDataFrame(pages, "entity_id bigint, title string, tags array<string>, domain string, url string, file string")
    sites = spark.createDataFrame([("old.example", "Old"), ("new.example", "New")], "domain string, site_name string")
    wiki = spark.createDataFrame([(i, f"w{i}", t, None, None) for i, t in enumerate(shows)], "rec_id bigint, wiki_id string, title string, alt_name string, first_aired string")
    frames = induce_frames(page_titles(df, sites))
    assert ("chapter # of", "// thoughts") in frames and ("", "in # pictures") in frames and ("* joins", "") in frames
    assert not any("liked" in f[0] for f in frames)
    assert framed_name("Chapter 7 of Bada Lomi // thoughts", frames) == "badalomi" and framed_name("Bada Lomi", frames) == "badalomi"
    got = {r.entity_id: r.wiki_id for r in link(df, wiki, sites).collect()}
    assert sum(got.get(i) == w for i, w in want.items()) >= 0.98 * len(want)
    assert not set(got) & set(compared)


def test_consensus_and_exclusivity_decide(spark):
    pair = lambda page, rec, tag, own, year: (page, "quietlamp", rec, 1.0, tag, own, year)
    rows = [pair(0, "a", 0.0, 0.0, 0), pair(0, "b", 0.0, 0.0, 0)] + [r for i in range(1, 9) for r in (pair(i, "a", 1.0, 0.0, 1), pair(i, "b", 0.0, 0.0, -1))]
    df = spark.createDataFrame(rows, "entity_id bigint, title_key string, wiki_id string, by_title double, by_tag double, own double, year int")
    alone, joint = ({(r.entity_id, r.wiki_id): r.confidence for r in solve(df, k).collect()} for k in (1, 12))
    assert abs(alone[0, "a"] - 0.5) < 0.01 and abs(alone[0, "b"] - 0.5) < 0.01
    assert joint[0, "a"] > joint[0, "b"] + 0.02 and joint[0, "a"] + joint[0, "b"] <= 1 + 1e-6
    assert solve(df.where("entity_id = 0"), 12).agg(F.max("confidence")).first()[0] < 0.53
