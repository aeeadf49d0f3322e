"""Wiki pages: splittable dump scan, infobox attributes, clean values. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import FOOTNOTES, UNWRAP, decode_char_refs, let

#: Infobox attribute -> its keys in wiki text.
ATTRIBUTES = {
    "alt_name": ("alt_name",), "creator": ("creator",), "based_on": ("based_on", "adaptation"), "writer": ("writer", "written_by"), "director": ("director", "directed_by"),
    "starring": ("starring",), "music": ("music", "music_by", "theme_music_composer"), "opening_theme": ("opening_theme", "open_theme"), "ending_theme": ("ending_theme", "end_theme"),
    "executive_producer": ("executive_producer",), "producer": ("producer", "produced_by"), "camera_setup": ("camera_setup", "camera"), "runtime": ("runtime", "running_time"),
    "budget": ("budget",), "location": ("location",), "company": ("company", "production_company", "production_companies"), "network": ("network", "original_network", "channel"),
    "first_aired": ("first_aired", "release", "original_release", "aired"), "last_aired": ("last_aired", "ended"), "num_seasons": ("num_seasons", "seasons"), "num_episodes": ("num_episodes", "episodes"),
    "genre": ("genre",), "language": ("language", "original_language"), "country": ("country", "country_of_origin"),
}
#: Kinds of infobox that describe a series.
INFOBOX_KINDS = ("television", "tv", "drama", "series", "show", "web", "serial", "miniseries")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row for each page of an XML dump. The page end parts records, so the file splits and no page is lost at a border."""
    return spark.read.option("lineSep", "</page>").text(path).where(F.col("value").contains("<page>"))


def page_parts(pages: DataFrame, raw: str = "value") -> DataFrame:
    """(title, wiki_id, timestamp, username, text) of dump pages; absent parts are empty."""
    x = F.regexp_replace(F.col(raw), r"[^\x00-\x7F]", " ")
    part = lambda tag: F.coalesce(F.regexp_extract(x, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    return pages.select(part("title").alias("title"), part("id").alias("wiki_id"), part("timestamp").alias("timestamp"), part("username").alias("username"), part("text").alias("text"))


def infobox(text: Column) -> Column:
    """Map of the infobox's keys, in lower case, to their raw values; of a repeated key the first counts."""
    body = F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n"))
    key, value = r"(?m)^[ \t]*\|[ \t]*(\w+)[ \t]*=", r"(?ms)^[ \t]*\|[ \t]*\w+[ \t]*=[ \t]*(.*?)(?=\n[ \t]*\|[ \t]*\w+[ \t]*=|\n\}\}(?:\n(?![}|])|\{\{Unreliable sources|'|\z)|\z)"
    keys = F.transform(F.regexp_extract_all(body, F.lit(key), F.lit(1)), F.lower)
    pairs = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(body, F.lit(value), F.lit(1)).alias("v"))
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), (F.array_position(keys, p["k"]) == i + 1).alias("first"))), lambda p: p["first"])
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def has_infobox(text: Column, kinds: tuple[str, ...] = INFOBOX_KINDS) -> Column:
    """Whether the page describes a series; the cheap test comes first."""
    return F.lower(text).contains("{{infobox") & text.rlike(r"(?i)\{\{Infobox\s*(?:" + "|".join(kinds) + r")[\s|]")


def clean_value(col: Column) -> Column:
    """Plain value of an attribute: dates and amounts written out, lists with commas, no markup; empty for null.

    Values without any sign of markup skip its rules.
    """
    return let(F.coalesce(col, F.lit("")), lambda v: F.when(v.rlike(r"[&<>{}\[\]*'|=~_`\\(\n]"), _marked_value(v)).otherwise(F.trim(F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[\s,]+|[\s,]+$", ""))))


def _marked_value(col: Column) -> Column:
    v = decode_char_refs(col)
    v = F.regexp_replace(F.regexp_replace(v, r"\n\|\s*$", ""), r"\n+", " \n")
    date = r"(?i)\{\{\s*(?:start|end)[ _]*date\b[^|{}]*(?:\|[^|={}]*=[^|{}]*)*\|(\d{4})(?:\|([^|{}]*))?(?:\|([^|{}]*))?(?:\|[^{}]*)?\}\}"
    # month and day count each if they are digits; marks keep their places until the blanks go
    v = F.regexp_replace(v, date, "$1\u0003$2\u0003$3\u0003")
    v = F.regexp_replace(v, r"\u0003(?![ \t]*\d+[ \t]*\u0003)[^\u0003\n]*(?=\u0003)", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\u0003[ \t]*(\d+)[ \t]*(?=\u0003)", "-$1"), r"\u0003", "")
    for p in FOOTNOTES:
        v = F.regexp_replace(v, p, "")
    for unit, name in (("billion", " billion"), ("million", " million"), ("", "")):
        for kind, code in ((r"SK[ _]?won", "SK WON"), ("KRW", "KRW"), (r"USD|US\$", "USD")):
            inner = rf"([^{{}}|]*?)\s*{unit}" if unit else r"([^{}|]*?)"
            v = F.regexp_replace(v, rf"(?i)\{{\{{\s*(?:{kind})\s*\|\s*{inner}\s*(?:\|[^{{}}]*)?\}}\}}", f"$1{name} {code}")
    v = F.regexp_replace(v, r"(?i)\{\{\s*based on\s*\|([^|{}]+)\|([^{}]+)\}\}", "$1 by $2")
    v = F.regexp_replace(v, r"(?i)\[\[(?:file|image):[^\]]*\]\]|\{\{\s*(?:hidden|lang|korean|ko-h|ko-translit|efn|cite|ref)\b[^{}]*\}\}", "")
    for p, to in UNWRAP:
        v = F.regexp_replace(v, p, to)
    lists = r"(?i)\{\{\s*(?:pl|plain ?list|ubl|flat ?list|h ?list|unbulleted[ _]list|theme song)\s*\|([^{}]*)\}\}"
    head = r"(?is)\{\{\s*(?:pl|plain ?list|ubl|flat ?list|h ?list|unbulleted[ _]list|theme song)\s*\|.*$"

    def opened(t: Column) -> Column:
        items = F.filter(F.transform(F.split(F.regexp_extract(t, lists, 1), r"\||\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*\s*", ""))), lambda x: x != "")
        return F.when(t.rlike(lists), F.concat(F.regexp_replace(t, head, ""), F.array_join(items, ", "), F.regexp_replace(t, "(?s)^.*?" + lists.replace("(?i)", "(?i:", 1) + ")", ""))).otherwise(t)

    v = let(v, opened)
    v = F.regexp_replace(F.regexp_replace(v, r"(?m)^\s*\*\s*", "* "), r"^\* ", "")
    for p, to in ((r"\s*\n?\* ", ", "), (r"(?i)<br\s*/?\s*>", ", "), (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"\}\}\s*$", ""), (r"<[^>]+>", ""), (r"={2,}\s*[^=]+={2,}", ""), (r"\(\s*\)", ""), (r"\|[^=|]*=", ""), (r"\|", ", "), ("=", ""), (r"\s+", " ")):
        v = F.regexp_replace(v, p, to)
    return F.trim(F.regexp_replace(v, r"^[\s,]+|[\s,]+$", ""))


def records(pages: DataFrame, country: str = "south korea", language: str = "korean") -> DataFrame:
    """The 29 columns of a series record from (title, wiki_id, timestamp, username, text); pages without a matching infobox, country and language are left out.

    Texts of a dump are encoded twice: references are decoded before the markup rules and once more behind them.
    """
    value = lambda box, name: F.coalesce(*[F.try_element_at(box, F.lit(k)) for k in ATTRIBUTES[name]])

    def qualifies(box: Column) -> Column:
        return F.lower(clean_value(value(box, "country"))).contains(country) & F.lower(clean_value(value(box, "language"))).contains(language)

    # the box of a page is read once: a test on an array's element isn't copied below the step that makes it
    x = pages.where((F.col("text") != "") & has_infobox(F.col("text"))).select(
        "wiki_id", "title", "timestamp", "username", "text", F.explode(F.filter(F.array(infobox(F.col("text"))), qualifies)).alias("_box"))
    x = x.withColumn("_values", F.transform(F.array(*[value(F.col("_box"), n) for n in ATTRIBUTES]), clean_value))
    synopsis = F.coalesce(*[F.nullif(F.regexp_extract("text", rf"(?is)==\s*{h}\s*==(.*?)(?=\n==|\z)", 1), F.lit("")) for h in ("Synopsis", "Plot")])
    return x.select("wiki_id", decode_char_refs(F.col("title")).alias("title"), "timestamp", "username",
                    *[decode_char_refs(F.get("_values", i)).alias(n) for i, n in enumerate(ATTRIBUTES)], decode_char_refs(clean_value(synopsis)).alias("synopsis"))
