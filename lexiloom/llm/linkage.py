"""Pages linked to records without a common key, by soft logic with a confidence.

Which words frame the name in a title is induced: titles that hold one of their page's own tags show
what stands before and behind a name; a frame counts if it surrounds several names and enough of the
titles it fits agree with a tag (``induce_frames``). So no list of titles is needed, a site with ways
of its own teaches them, and titles that only compare or list shows, whose tags never agree, frame nothing.

Evidence comes from equi-joins only: the name a page's title frames, and each of its tags, are folded
to letters and digits and meet the folded titles and alternative names of the records; names with one
slip (a letter left out or added, or two neighbours swapped) meet through their one-letter deletions.
A name that a tag of the page spells the same way is no slip.

Weighted rules over the truth values x(page, record) in [0, 1], as squared hinge losses:
    framed name equals a name of the record          -> x    (weight by similarity)
    a tag equals a name of the record                -> x
    one of these names belongs to this record alone  -> x
    the page states the record's year / another year -> x / not x
    no rule speaks for it                            -> not x
    pages that use the same name in their title mean the same record (transitivity by name)
    a page is about one record: the x of a page sum up to at most 1 (exclusivity)
The convex problem is solved by alternating directions: each page solves its own block (rules, then
projection on the exclusivity constraint), names average the blocks that share them, and the rounds
repeat. The value of x is the confidence.

Scale: titles are read once and written to the checkpoint folder. Frames are collected: each surrounds
at least ``FRAME_SHARE`` of the titles, so their number is bounded. Blocks are rows; names are averaged
with map-side combine and joined back over salts, so a name used by a third of all pages is no hot
spot. A page's block holds the records that share one of its names, whatever their number; ties
between records without further evidence leave each below the bar.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.domains import site_key
from lexiloom.functions.text import decode_char_refs, squeeze
from lexiloom.operators.packed import unpack
from lexiloom.runtime import cut

#: Most words before and behind a name in a title, and the least number of names, their share of the titles that a frame fits and of all titles, for the frame to count.
LEFT, RIGHT = 4, 5
FRAME_NAMES, FRAME_AGREE, FRAME_SHARE = 3, 0.05, 1 / 20_000
W_NAME, W_TAG, W_OWN, W_YEAR, W_OTHER_YEAR, W_NONE, W_SAME_NAME = 1.0, 1.2, 1.2, 0.8, 0.7, 0.15, 0.1
SLIP_SIMILARITY, SLIP_LENGTH = 0.9, 8
BAR, ROUNDS, TOLERANCE, INNER, RHO, SALTS = 0.53, 12, 0.01, 60, 1.0, 16

_SIGNS = re.compile(r"[\W_]")
_DIGITS = re.compile(r"\d+")


def fold_name(col: Column) -> Column:
    """Letters and digits of a name in lower case; ``&`` reads as and."""
    return F.regexp_replace(F.lower(F.replace(decode_char_refs(col), F.lit("&"), F.lit(" and "))), r"[^\p{L}\p{N}]", "")


def _deletions(key: Column) -> Column:
    """A key and all ways to leave out one of its letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key)))))


def record_names(records: DataFrame) -> DataFrame:
    """(key, wiki_id, own): folded titles and alternative names; own is 1 if no other record bears the name.

    Copies and revisions of a record fold into one set of names.
    """
    titles = records.select("wiki_id", F.regexp_replace("title", r"\s*\([^()]*\)\s*$", "").alias("name"))
    alts = unpack(records, "rec_id", ("alt_name",)).join(records.select("rec_id", "wiki_id"), "rec_id").select("wiki_id", F.col("val").alias("name"))
    names = titles.unionByName(alts).select(fold_name(F.col("name")).alias("key"), "wiki_id").where("wiki_id is not null and length(key) > 1").distinct()
    bearers = names.groupBy("key").agg(F.when(F.count("*") == 1, 1.0).otherwise(0.0).alias("own"))
    return names.join(bearers, "key")


def record_years(records: DataFrame) -> DataFrame:
    """(wiki_id, years): years in the title's brackets, else of the first airing."""
    stated = F.regexp_extract("title", r"\((?:[^()]*\s)?((?:19|20)\d\d)\b[^()]*\)\s*$", 1)
    aired = F.regexp_extract("first_aired", r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1)
    year = F.coalesce(F.nullif(stated, F.lit("")), F.nullif(aired, F.lit("")))
    return records.where("wiki_id is not null").groupBy("wiki_id").agg(F.collect_set(year).alias("years"))


def page_titles(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(entity_id, t, tag_keys, years) of pages (entity_id, title, tags, domain, url, file); t is the title without site name and year."""
    names = sites.select(site_key(F.col("domain")).alias("_site"), F.col("site_name")).dropDuplicates(["_site"])
    site = F.coalesce(site_key(F.col("domain")), site_key(F.col("url")), F.split_part("file", F.lit("_"), F.lit(1)))
    p = pages.select("entity_id", squeeze(decode_char_refs(F.col("title"))).alias("t"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), site.alias("_site")).join(names, "_site", "left")
    tail = F.concat(F.lit(r"\s+[»|\-–—:·]\s+\Q"), F.coalesce("site_name", F.lit("-")), F.lit(r"\E$"))
    p = p.withColumn("t", F.coalesce(F.regexp_replace(F.col("t"), tail, F.lit("")), F.lit("")))
    bracket = r"\s*\(((?:19|20)\d\d)\)"
    p = p.withColumn("y", F.regexp_extract("t", bracket, 1)).withColumn("t", F.regexp_replace("t", bracket, ""))
    tag_year = r"^(?:.*[\s-])?\(?((?:19|20)\d\d)\)?(?: drama)?$"
    tags = F.array_distinct(F.filter("tags", lambda x: x.isNotNull()))
    keys = F.array_distinct(F.flatten(F.transform(tags, lambda x: F.array(fold_name(x), fold_name(F.regexp_replace(x, r"[\s-]*\(?(?:19|20)\d\d\)?(?: drama)?$", ""))))))
    years = F.array_distinct(F.concat(F.filter(F.array("y"), lambda v: v != ""), F.filter(F.transform(tags, lambda x: F.regexp_extract(x, tag_year, 1)), lambda v: v != "")))
    return p.select("entity_id", "t", F.filter(keys, lambda k: F.length(k) > 1).alias("tag_keys"), years.alias("years"))


def _fold(text: str) -> str:
    return _SIGNS.sub("", text.lower().replace("&", " and "))


def splits(words: list[str]) -> Iterator[tuple[tuple[str, str], int, int]]:
    """(frame, start, end) of every way to take a name out of a title: the whole words before it, or any words and one more, and the whole words behind it; digits masked."""
    low = [_DIGITS.sub("#", w.lower()) for w in words]
    n = len(words)
    for j in range(n, max(0, n - RIGHT - 1), -1):
        right = " ".join(low[j:])
        for i in range(min(LEFT, j - 1) + 1):
            yield (" ".join(low[:i]), right), i, j
        for i in range(2, j):
            yield ("* " + low[i - 1], right), i, j


def own_frames(title: str, tag_keys: set[str]) -> dict[tuple[str, str], str]:
    """Frames of a title around one of the page's own tags, with the tag."""
    words = title.split()
    out = {}
    for frame, i, j in splits(words):
        if frame != ("", "") and (key := _fold("".join(words[i:j]))) in tag_keys:
            out[frame] = key
    return out


def induce_frames(titles: DataFrame) -> set[tuple[str, str]]:
    """What stands before and behind the name that a page is about, learned from titles that hold one of their page's tags.

    A frame counts if it surrounds FRAME_NAMES different tags and at least FRAME_AGREE of the titles
    that it fits agree with a tag of their page: titles that only compare or list shows don't.
    """
    def found(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(*f, k) for t, keys in zip(pdf["t"], pdf["tag_keys"]) if t and len(keys) for f, k in own_frames(t, set(keys)).items()}
            yield pd.DataFrame(list(rows), columns=["before", "behind", "name"])

    n = titles.count()
    names = titles.mapInPandas(found, "before string, behind string, name string").distinct().groupBy("before", "behind").agg(F.count("*").alias("n"))
    able = {(r["before"], r["behind"]) for r in names.where(F.col("n") >= max(FRAME_NAMES, n * FRAME_SHARE)).collect()}

    def fits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[tuple[str, str], list[int]] = {}
        for pdf in batches:
            for t, keys in zip(pdf["t"], pdf["tag_keys"]):
                words, own = t.split(), set(keys)
                for f in {f: _fold("".join(words[i:j])) in own for f, i, j in splits(words) if f in able}.items():
                    c = count.setdefault(f[0], [0, 0])
                    c[0] += 1
                    c[1] += f[1]
        yield pd.DataFrame([(*f, *c) for f, c in count.items()], columns=["before", "behind", "fits", "agree"])

    if not able:
        return able
    rates = titles.mapInPandas(fits, "before string, behind string, fits bigint, agree bigint").groupBy("before", "behind").agg(F.sum("fits").alias("fits"), F.sum("agree").alias("agree"))
    return {(r["before"], r["behind"]) for r in rates.where(F.col("agree") >= FRAME_AGREE * F.col("fits")).collect()}


def framed_name(title: str, frames: set[tuple[str, str]]) -> str:
    """Folded name in the closest frame of a title: the most words, whole ones before cut ones; the whole title if no frame fits."""
    words = title.split()
    best, core = (0, 0), "".join(words)
    for frame, i, j in splits(words):
        if frame in frames:
            size = (len(words) - j + (1 if frame[0].startswith("* ") else i), -i)
            if size > best:
                best, core = size, "".join(words[i:j])
    return _fold(core)


def page_names(titles: DataFrame, frames: set[tuple[str, str]]) -> DataFrame:
    """(entity_id, title_key, tag_keys, years) of pages (entity_id, t, tag_keys, years)."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(title_key=[framed_name(t, frames) for t in pdf["t"]])[["entity_id", "title_key", "tag_keys", "years"]]

    return titles.mapInPandas(run, "entity_id bigint, title_key string, tag_keys array<string>, years array<string>")


def evidence(names: DataFrame, dictionary: DataFrame, years: DataFrame) -> DataFrame:
    """(entity_id, title_key, wiki_id, by_title, by_tag, own, year): what speaks for each candidate pair."""
    title = names.where("length(title_key) > 1").select("entity_id", "title_key", F.array_contains("tag_keys", F.col("title_key")).alias("spelled"))
    zero, one = F.lit(0.0), F.lit(1.0)
    exact = title.join(dictionary, title.title_key == dictionary.key).select("entity_id", "wiki_id", one.alias("by_title"), zero.alias("by_tag"), "own")
    rest = title.where(~F.col("spelled") & (F.length("title_key") >= SLIP_LENGTH)).select("title_key").distinct().join(dictionary.select(F.col("key").alias("title_key")).distinct(), "title_key", "left_anti")
    long = dictionary.where(F.length("key") >= SLIP_LENGTH)
    left = rest.select("title_key", F.explode(F.array_append(_deletions(F.col("title_key")), F.col("title_key"))).alias("d"))
    right = long.select("key", F.explode(F.array_append(_deletions(F.col("key")), F.col("key"))).alias("d")).distinct()
    near = left.join(right, "d").select("title_key", "key").distinct()
    gap = F.levenshtein("title_key", "key")
    letters = lambda c: F.array_sort(F.split(c, ""))
    same_length = F.length("title_key") == F.length("key")
    near = near.where((gap == 1) & ~same_length | (gap == 2) & same_length & (letters(F.col("title_key")) == letters(F.col("key"))))
    slips = title.where(~F.col("spelled")).join(near, "title_key").join(long, "key").select("entity_id", "wiki_id", F.lit(SLIP_SIMILARITY).alias("by_title"), zero.alias("by_tag"), "own")
    tags = names.select("entity_id", F.explode("tag_keys").alias("key")).join(dictionary, "key").select("entity_id", "wiki_id", zero.alias("by_title"), one.alias("by_tag"), "own")
    pairs = exact.unionByName(slips).unionByName(tags).groupBy("entity_id", "wiki_id").agg(*[F.max(c).alias(c) for c in ("by_title", "by_tag", "own")])
    both = pairs.join(names.select("entity_id", "title_key", F.col("years").alias("page_years")), "entity_id").join(years, "wiki_id")
    year = F.when((F.size("page_years") == 0) | (F.size("years") == 0), 0).when(F.arrays_overlap("page_years", "years"), 1).otherwise(-1)
    return both.select("entity_id", "title_key", "wiki_id", "by_title", "by_tag", "own", year.alias("year"))


def _project(v: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Nearest point with values from 0 and a sum of at most 1 in each block."""
    over = np.bincount(block, np.maximum(v, 0), n) > 1
    lo, hi = np.zeros(n), np.maximum(np.array([0.0] * n), 0) + (v.max() if len(v) else 0)
    for _ in range(40):
        mid = (lo + hi) / 2
        big = np.bincount(block, np.maximum(v - mid[block], 0), n) > 1
        lo, hi = np.where(big, mid, lo), np.where(big, hi, mid)
    return np.maximum(v - np.where(over, hi, 0)[block], 0)


def _solve(by_title, by_tag, own, year, target, pull, start, block, n) -> np.ndarray:
    """Blocks of all pages of a batch at once: potentials and exclusivity alternate."""
    y = start.copy()
    u = np.zeros_like(y)
    lin = np.stack([np.where(by_title > 0, W_NAME, 0), np.where(by_tag > 0, W_TAG, 0), np.where(own > 0, W_OWN, 0), np.where(year > 0, W_YEAR, 0)])
    goal = np.stack([by_title, by_tag, np.ones_like(y), np.ones_like(y)])
    down = W_NONE + np.where(year < 0, W_OTHER_YEAR, 0)
    for _ in range(INNER):
        v = y - u
        x = v.copy()
        for _ in range(3):  # squared hinges: the active ones are fixed after few passes
            act = lin * (goal > x[None, :])
            x = (2 * (act * goal).sum(0) + 2 * pull * target + RHO * v) / (2 * act.sum(0) + 2 * down + 2 * pull + RHO)
        y = _project(x + u, block, n)
        u += x - y
    return y


def _round(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = len(pdf)
        sizes = pdf["cands"].map(len).to_numpy()
        flat = [c for cands in pdf["cands"] for c in cands]
        block = np.repeat(np.arange(n), sizes)
        col = lambda k: np.array([c[k] for c in flat], float)
        dual, mean = col("dual"), col("mean")
        known = mean >= 0
        dual = np.where(known, dual + col("x") - np.where(known, mean, 0), 0.0)
        x = _solve(col("by_title"), col("by_tag"), col("own"), col("year"), np.where(known, mean - dual, 0), np.where(known, W_SAME_NAME, 0.0), col("x"), block, n) if flat else np.array([])
        out, at = [], 0
        for cands, size in zip(pdf["cands"], sizes):
            out.append([{**{k: c[k] for k in ("wiki_id", "by_title", "by_tag", "own", "year")}, "x": float(x[at + i]), "dual": float(dual[at + i]), "mean": c["mean"]} for i, c in enumerate(cands)])
            at += size
        yield pd.DataFrame({"entity_id": pdf["entity_id"], "title_key": pdf["title_key"], "cands": out})


CANDS = "array<struct<wiki_id:string,by_title:double,by_tag:double,own:double,year:int,x:double,dual:double,mean:double>>"


def solve(pairs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(entity_id, wiki_id, confidence) of all candidate pairs; rounds end when no mean moves by more than ``tolerance``."""
    blocks = pairs.groupBy("entity_id", "title_key").agg(F.array_sort(F.collect_list(F.struct(
        "wiki_id", "by_title", "by_tag", "own", F.col("year").cast("int").alias("year"), F.lit(0.0).alias("x"), F.lit(0.0).alias("dual"), F.lit(-1.0).alias("mean")))).cast(CANDS).alias("cands"))
    schema = f"entity_id bigint, title_key string, cands {CANDS}"
    blocks = cut(blocks)
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    for _ in range(rounds):
        blocks = cut(blocks.mapInPandas(_round, schema))
        named = blocks.select("title_key", F.explode("cands").alias("c")).where("c.by_title > 0")
        pair_means = named.groupBy("title_key", "c.wiki_id").agg(F.avg("c.x").alias("mean"), F.avg("c.mean").alias("last"))
        means = cut(pair_means.groupBy("title_key").agg(F.map_from_entries(F.collect_list(F.struct("wiki_id", "mean"))).alias("means"), F.max(F.abs(F.col("mean") - F.col("last"))).alias("moved")))
        if (means.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
        # a name used by a third of all pages would be one task: it is spread over salts
        spread = means.select(F.col("title_key").alias("_name"), "means", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        joined = blocks.join(spread, (F.col("title_key") == F.col("_name")) & (salt("entity_id") == F.col("_salt")), "left")
        blocks = joined.select("entity_id", "title_key", F.transform("cands", lambda c: c.withField("mean", F.when(
            c["by_title"] > 0, F.coalesce(F.try_element_at("means", c["wiki_id"]), F.lit(-1.0))).otherwise(F.lit(-1.0)))).alias("cands"))
    return blocks.select("entity_id", F.explode("cands").alias("c")).select("entity_id", "c.wiki_id", F.col("c.x").alias("confidence"))


def link(pages: DataFrame, records: DataFrame, sites: DataFrame, bar: float = BAR) -> DataFrame:
    """(entity_id, wiki_id, confidence): the record each page is about, if one reaches ``bar``.

    Null titles and tags, blank names, pages without candidates and records without names give no
    row; crawls of one page are linked each; copies and revisions of a record count as one.
    """
    dictionary = cut(record_names(records))
    titles = cut(page_titles(pages, sites))
    names = cut(page_names(titles, induce_frames(titles)))
    scored = solve(evidence(names, dictionary, record_years(records)))
    w = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "wiki_id")
    return scored.where(F.col("confidence") >= bar).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
