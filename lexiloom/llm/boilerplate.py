"""Page frames told from articles by wrapper induction over pages of one host.

A page is an ordered tree: root, lines, words. A host's template is a tree too: head, article slot
and foot in this order, with the host's constant nodes below them; the slot's own constant nodes are
widgets, which may stand anywhere in it. A page is aligned with the template of its host:

* A line matches a node of the same label (digits masked) or opening (up to a colon), or a node with which simple tree matching
  (largest order-keeping matching of children) pairs all of its words (menus cut short).
* The root's children keep their order, the boxes inside head and foot may swap places: the page is
  cut in three so that the head has the most lines matched by head nodes, the foot the most matched
  by foot nodes and their lists, and the slot the most text that varies.
* What the slot holds is the article, but for widgets. A line that looks like a head or foot node but
  stays unmatched inside the slot is article.

Constant nodes come from counts over all pages: labels are counted per host, region and distinct
path. The region of a line is taken from the varying sentences of its page: before the line above the
first, after the last, or between.

Scale: lines are made once, as hashes, and written to the checkpoint folder; texts are read once and
never shuffled. The counts combine before the shuffle, so a host with a third of all pages spreads
over its labels. A host's template holds labels of at least ``MIN_SHARE`` of its pages (in the head
``RARE`` of several hosts' pages), so its size is bounded by lines per page / RARE whatever the number
of pages. Pages aren't shuffled by host: the templates join without a hint, so they are broadcast only
if small.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.domains import site_key
from lexiloom.runtime import cut

#: Share of a host's pages from which a label is a constant node, and the weight (in pages) of its share over all hosts that know it.
MIN_SHARE, PRIOR_PAGES = 0.033, 300
#: Hosts from which a label is judged over all hosts; the share of its lines in the head, and of the hosts' pages, from which it is a head node.
MIN_HOSTS, APART, RARE = 3, 0.95, 0.002
#: Worth of a matched node and of a varying sentence; other varying lines count by length up to LINE.
NODE, SENTENCE, LINE = 1.5, 2.0, 0.9
MOST_WORDS = 16

_DIGITS = re.compile(r"\d[\d.,]*")
_PREFIX = re.compile(r"([^\s:»]+(?: [^\s:»]+){0,3}\s?[:»]) ")
_END = re.compile(r"[.!?。！？][\"”'’」』)]?$")
_OPEN = re.compile(r"(?:\.\.\.|\?|？|…)$")
_PARTS = re.compile(r"[^\w#]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")

PAGE = "page_id bigint, host string, path bigint, line_no array<int>, label array<bigint>, prefix array<bigint>, sentence array<boolean>, size array<int>, words array<array<bigint>>"


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_KNOWN: dict[str, tuple] = {}
MOST_KNOWN = 100_000


def _line(s: str) -> tuple:
    """(label, prefix, sentence, size, hashes of words) of a line; constant lines come again and again."""
    found = _KNOWN.get(s)
    if found is None:
        label = _DIGITS.sub("#", s)
        prefix = _PREFIX.match(label)
        sentence = bool(_END.search(s[-2:])) and not _OPEN.search(s[-3:]) and (s.count(" ") >= 3 or len(_WIDE.findall(s)) >= 10)
        hashes = []
        if not sentence:
            parts = [p for p in _PARTS.split(label) if p]
            if 1 < len(parts) <= MOST_WORDS:
                hashes = [_hash(p) for p in parts]
        found = (_hash(label), _hash("\0" + prefix.group(1)) if prefix else 0, sentence, len(s), hashes)
        if not sentence:
            if len(_KNOWN) >= MOST_KNOWN:
                _KNOWN.clear()
            _KNOWN[s] = found
    return found


def lines_of(text: str) -> list[tuple]:
    """(line_no, label, prefix, sentence, size, words) of the non-blank lines of a text."""
    text = text.replace("\u200b", " ").replace("\ufeff", " ")
    lines = ((i, " ".join(raw.split())) for i, raw in enumerate(text.split("\n"), 1))
    return [(i, *_line(s)) for i, s in lines if s]


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PAGE.split(", ")]
    for whole in batches:
        for lo in range(0, len(whole), 1000):
            rows = []
            for key, host, path, text in whole.iloc[lo:lo + 1000][["page_id", "host", "path", "text"]].itertuples(index=False):
                found = lines_of(text)
                if found:
                    rows.append((key, host, _hash(path) if path else key, *map(list, zip(*found))))
            yield pd.DataFrame(rows, columns=names)


def page_lines(df: DataFrame) -> DataFrame:
    """The pages (page_id, path, domain, text) as trees of hashes, without pages that have no line."""
    site = F.regexp_replace(F.col("path"), r"^.*?data-extracted/", "")
    host = F.coalesce(site_key(F.split_part("path", F.lit("/"), F.lit(-2))), site_key(F.col("domain")), site_key(F.split_part(site, F.lit("/"), F.lit(1))), F.lit(""))
    return df.where(F.col("text").rlike(r"\S")).select("page_id", host.alias("host"), "path", "text").mapInPandas(_read, PAGE)


def with_varying(pages: DataFrame) -> DataFrame:
    """Add ``varying`` to pages: which lines are sentences that don't return on their host or over hosts."""
    sizes = pages.groupBy("host").agg(F.countDistinct("path").alias("pages"))
    counts = pages.select("host", F.explode(F.filter(F.arrays_zip("label", "sentence"), lambda x: x["sentence"])).alias("x")).groupBy("host", F.col("x.label").alias("label")).agg(F.count("*").alias("n")).where("n > 1").join(sizes, "host")
    overall = counts.groupBy("label").agg((F.sum("n") / F.sum("pages")).alias("share"), F.count("*").alias("hosts"))
    again = counts.join(overall, "label").where((F.col("n") > 2) & (F.col("n") >= MIN_SHARE * F.col("pages")) | (F.col("hosts") >= MIN_HOSTS) & (F.col("share") >= MIN_SHARE / 4))
    again = again.groupBy("host").agg(F.collect_set("label").alias("again"))
    varying = F.transform("sentence", lambda s, i: s & ~F.array_contains(F.coalesce("again", F.array().cast("array<bigint>")), F.get("label", i)))
    return pages.join(again, "host", "left").withColumn("varying", varying).drop("again", "sentence")


def templates(pages: DataFrame) -> DataFrame:
    """(host, nodes): the constant nodes of each host, from the trees of its pages; of a node: place, label, words and whether it belongs to head, foot or slot."""
    sizes = pages.groupBy("host").agg(F.countDistinct("path").alias("pages"))
    x = pages.select("host", "path", "label", "prefix", "words", F.col("varying").alias("v")).where(F.array_contains("v", True))
    x = x.withColumns({"first": F.array_position("v", True) - 1, "last": F.size("v") - F.array_position(F.reverse("v"), True), "n": F.size("v")})

    def region(i: Column) -> Column:
        return F.when(i < F.col("first") - 1, "head").when(i > F.col("last"), "foot").when(i >= F.col("first"), "slot")

    def node(label: Column, i: Column) -> Column:
        # varying sentences are no constant nodes: they are left out before the shuffle
        return F.struct(label.alias("label"), F.when(~F.get("v", i), region(i)).alias("region"), (i / F.col("n")).alias("pos"), F.when(region(i) == "head", F.get("words", i)).alias("words"))

    def named(prefix: Column, i: Column) -> Column:
        place = F.when(i < F.col("first") - 1, "head").when(i < F.col("first"), "above").when(i > F.col("last"), "list").otherwise("slot")
        return F.struct(prefix.alias("label"), place.alias("region"), (i / F.col("n")).alias("pos"), F.lit(None).cast("array<bigint>").alias("words"))

    both = F.concat(F.transform("label", node), F.filter(F.transform("prefix", named), lambda p: p["label"] != 0))
    both = F.filter(both, lambda p: p["region"].isNotNull())
    nodes = x.select("host", "path", F.explode(both).alias("x")).groupBy("host", "x.label", "x.region", "path").agg(F.avg("x.pos").alias("pos"), F.first("x.words").alias("words"))
    per_host = nodes.groupBy("host", "label", "region").agg(F.count("*").alias("n"), F.avg("pos").alias("pos"), F.first("words").alias("words")).join(sizes, "host")
    per_host = cut(per_host)
    overall = per_host.groupBy("label", "region").agg((F.sum("n") / F.sum("pages")).alias("share"), F.sum("n").alias("all_n"), F.count("*").alias("hosts"))
    lines = per_host.groupBy("label").agg(F.sum("n").alias("lines"))
    known = per_host.join(overall.join(lines, "label"), ["label", "region"])
    by_host = (F.col("n") + PRIOR_PAGES * F.col("share")) / (F.col("pages") + PRIOR_PAGES) >= MIN_SHARE
    # remarks of articles stand between sentences too: chance on one host must not make a widget of them
    slot = F.when(F.col("hosts") >= MIN_HOSTS, F.col("share") >= MIN_SHARE).otherwise(by_host & (F.col("n") > 2))
    apart = lambda share: F.col("all_n") >= share * F.col("lines")
    head = by_host & (F.col("n") > 1) & apart(0.5) | (F.col("hosts") >= MIN_HOSTS) & apart(APART) & (F.col("share") >= RARE)
    kept = known.where(F.when(F.col("region") == "slot", slot).when(F.col("region") == "head", head).when(F.col("region") == "foot", by_host & (F.col("n") > 1)).otherwise(False))
    return kept.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "region", "words"))).alias("nodes")).withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["label"].alias("label"), x["region"].alias("region"), x["words"].alias("words"))))


def simple_tree_matching(line: list[int], node: list[int]) -> int:
    """Size of the largest order-keeping matching of the words of a line and of a node."""
    row = [0] * (len(node) + 1)
    for x in line:
        before = 0
        for j, y in enumerate(node):
            before, row[j + 1] = row[j + 1], max(before + (x == y), row[j + 1], row[j])
    return row[-1]


class Template:
    """A host's constant nodes, ready for matching."""

    def __init__(self, nodes: list[dict]) -> None:
        self.slot, self.head, self.foot = ({x["label"] for x in nodes if x["region"] == r} for r in ("slot", "head", "foot"))
        self.menus = [list(x["words"]) for x in nodes if x["region"] == "head" and x.get("words") is not None and len(x["words"]) > 1]
        self.words = {w for m in self.menus for w in m}
        self.seen: dict[int, bool] = {}

    def in_head(self, label: int, prefix: int, words: list[int]) -> bool:
        """Whether a line matches a head node by its label or the opening before a colon, else by its words."""
        if label in self.head or prefix in self.head:
            return True
        if len(words) < 2:
            return False
        found = self.seen.get(label)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[label] = all(w in self.words for w in words) and any(simple_tree_matching(words, m) == len(words) for m in self.menus)
        return found


def matched(lines: list[bool]) -> list[int]:
    """Number of matched lines of each beginning."""
    out = [0]
    for x in lines:
        out.append(out[-1] + x)
    return out


def frame(page: dict, template: Template) -> list[int]:
    """Numbers of the lines of a page that are frame."""
    labels = list(page["label"])
    n = len(labels)
    heads = [template.in_head(x, p, list(w)) for x, p, w in zip(labels, page["prefix"], page["words"])]
    feet = [x in template.foot for x in labels]
    widget = [x in template.slot or p in template.slot for x, p in zip(labels, page["prefix"])]
    before, behind = matched(heads), matched(feet[::-1])[::-1]
    worth = [NODE if w else 0.0 if h or f else SENTENCE if s else min(LINE, size / 150) for w, h, f, s, size in zip(widget, heads, feet, page["varying"], page["size"])]
    # lists of titles behind a foot node are its slots: there they are worth as much as in the article
    lists, listed = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        lists[i] = lists[i + 1] + (worth[i] if not widget[i] and not page["varying"][i] else 0.0)
    for t in range(n - 1, -1, -1):
        listed[t] = lists[t] if feet[t] else 0.0
    total = [0.0]
    for v in worth:
        total.append(total[-1] + v)
    # best beginning up to each end: cuts h <= t
    best_h, at, best, cut_at = -1.0, 0, -1.0, (n, n)
    for t in range(n + 1):
        if t < n or n == 0:
            gain = NODE * before[t] - total[t]
            if gain > best_h + 1e-9 or t == 0:
                best_h, at = gain, t
        value = best_h + total[t] + NODE * behind[t] + listed[t]
        if value > best + 1e-9:
            best, cut_at = value, (at, t)
    h, t = cut_at
    return [int(x) for i, x in enumerate(page["line_no"]) if i < h or i >= t or widget[i]]


def _align(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, Template] = {}
    for pdf in batches:
        ids, numbers = [], []
        for page in pdf.to_dict("records"):
            template = known.get(page["host"])
            if template is None:
                if len(known) > 500:
                    known.clear()
                template = known[page["host"]] = Template(json.loads(page["nodes"] or "[]"))
            found = frame(page, template)
            ids += [page["page_id"]] * len(found)
            numbers += found
        yield pd.DataFrame({"page_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int32")})


def frame_lines(df: DataFrame) -> DataFrame:
    """Rows (page_id, line_no) of frame lines of pages (page_id, path, domain, text).

    Blank lines never count. Null and blank texts give no row; pages of unknown hosts share one
    template; repeated pages are judged each, but count once in their host's template.
    """
    pages = cut(with_varying(cut(page_lines(df))))
    # as text a template is read once a host and task, not once a page
    joined = pages.join(templates(pages).withColumn("nodes", F.to_json("nodes")), "host", "left").drop("path")
    return joined.mapInPandas(_align, "page_id bigint, line_no int")
