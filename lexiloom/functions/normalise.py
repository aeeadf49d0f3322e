"""Normal forms of titles, tags, names and queries. Characters outside the kept set are deleted, not replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a page of this domain, by stage.
TEXT_STOP_WORDS = ("episode", "episodes", "recap", "review", "reviews", "drama", "kdrama", "series", "season", "show", "actor", "actress", "cast", "scene", "story", "plot", "recaps", "tv", "korean")
SEARCH_STOP_WORDS = ("recap", "review", "reviews", "drama", "kdrama", "k drama", "show", "cast", "scene", "plot", "recaps", "tv", "korean")
FIELD_STOP_WORDS = ("episode", "episodes", "recap", "review", "reviews", "kdramas", "dramas", "drama", "kdrama", "series", "season", "show", "actor", "actress", "cast", "scene", "story", "plot", "recaps", "tv", "korean")
#: English function words; a parameter wherever it is used.
ENGLISH_STOP_WORDS = tuple("a about after all also an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its me more most my no not of on one or our out over she so some than that the their them then there these they this to up us was we were what when which who will with would you your".split())


def plain(col: Column) -> Column:
    """Lower case; only ASCII letters, digits and blanks stay; blanks are squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9\s]", ""), r"\s+", " "))


def page_title(col: Column) -> Column:
    """Normal form of a page title or tag."""
    return plain(F.trim(col))


def record_title(col: Column) -> Column:
    """Normal form of a record title: parts in round brackets are deleted first."""
    return plain(F.regexp_replace(F.lower(col), r"\([^)]*\)", ""))


def name_list(col: Column) -> Column:
    """Normal forms of the names in a comma list; blank ones are dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9,\s]", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def query_words(col: Column, stop_words: tuple[str, ...] = FIELD_STOP_WORDS) -> Column:
    """Words of a query: everything but ASCII letters and digits parts words, stop words go."""
    words = F.split(F.trim(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def keep_word(word: Column, stop_words: tuple[str, ...]) -> Column:
    """Whether a text word is kept: no stop word; of numbers only 1 to 50 with at most two digits, and years from 1880 to 2030."""
    n = word.try_cast("bigint")
    number = word.rlike("^[0-9]+$")
    return ~word.isin(*stop_words) & (~number | ((F.length(word) <= 2) & n.between(1, 50)) | n.between(1880, 2030))


def flatten_text(col: Column) -> Column:
    """Line breaks, tabs and other control characters become blanks."""
    return F.regexp_replace(col, r"[\r\n\t\x00-\x1f]+", " ")


def first_year(col: Column) -> Column:
    """First standalone number of four digits; empty if there is none."""
    return F.regexp_extract(col, r"\b(\d{4})\b", 1)
