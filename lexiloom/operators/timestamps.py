"""Mixed date and time texts in one unambiguous form.

Method: texts are parsed natively to local fields. Local times without an offset meet the zone's
offset intervals in an as-of join: intervals, in local time, are exploded to the years they touch,
so the join is an equi-join on (zone, year) against a table bounded by zones x years (years before or
after the table take the first or a late one of the same calendar), and the containing intervals are picked inside the row. Two containing intervals mean an ambiguous time (the
earlier instant counts), none a skipped one (the offset before the change counts), one gives the
offset. Nothing is collected and nothing is shuffled beyond the small side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import FOOTNOTES, decode_char_refs, squeeze

#: Years with intervals of their own. No zone changed before the first; after the last the rules repeat with the calendar.
YEARS = (1800, 2100)
#: A late year for each kind of calendar: by leap year and day of the week of the first of January (0 is Monday).
LIKE_YEARS = {(datetime(y, 12, 31).timetuple().tm_yday == 366, datetime(y, 1, 1).weekday()): y for y in range(2071, 2099)}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Zone letters with one meaning everywhere, in minutes east of Greenwich.
ZONE_LETTERS = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "kst": 540, "jst": 540, "wib": 420, "wita": 480, "wit": 540, "hkt": 480, "sgt": 480, "pht": 480, "ict": 420,
                "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "bst": 60,
                "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
                "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "ist": 330}
#: Zone letters that mean something else in a region (first part of the IANA name or the whole name).
REGIONAL_LETTERS = {("australia", "est"): 600, ("australia", "edt"): 660, ("australia", "cst"): 570, ("australia", "cdt"): 630, ("australia", "wst"): 480,
                    ("asia/shanghai", "cst"): 480, ("asia/taipei", "cst"): 480, ("asia/manila", "pst"): 480, ("europe/dublin", "ist"): 60, ("asia/jerusalem", "ist"): 120}


ENDLESS = -10**15


def _calendar_year(year: Column) -> Column:
    """The year whose intervals hold for a year: itself, the first one, or a late one with the same calendar."""
    leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366
    kind = F.weekday(F.make_date(year, F.lit(1), F.lit(1))) + F.when(leap, 7).otherwise(0)
    like = F.get(F.array(*[F.lit(LIKE_YEARS[lp, d]) for lp in (False, True) for d in range(7)]), kind)
    return F.when(year < YEARS[0], YEARS[0]).when(year > YEARS[1], like).otherwise(year)


def offset_intervals(zone: str, first: int = YEARS[0], last: int = YEARS[1]) -> list[tuple[int, int, int]]:
    """(local start, local end, offset) in seconds of every stretch with one offset, found by bisection; the first has no start."""
    tz = ZoneInfo(zone)
    at = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(tz).utcoffset().total_seconds())
    lo = int(datetime(first, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(last + 1, 1, 1, tzinfo=timezone.utc).timestamp())
    out, start, step = [], lo, 7 * 86400
    t, off = lo, at(lo)
    while t < end:
        nxt = min(t + step, end)
        if (new := at(nxt)) != off:
            a, b = t, nxt
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if at(m) == off else (a, m)
            out.append((start + off, b + off, off))
            start, off = b, at(b)
            t = b
        else:
            t = nxt
    out.append((start + off, end + off, off))
    return [(ENDLESS, *out[0][1:]), *out[1:]]


def _explode_zones(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for zone in pdf["zone"]:
            try:
                spans = offset_intervals(zone)
            except Exception:  # unknown zone name: no intervals, its local times have no instant
                continue
            epoch = datetime(1970, 1, 1)
            for a, b, off in spans:
                first = YEARS[0] if a == ENDLESS else (epoch + timedelta(seconds=a - 86400)).year
                for year in range(first, (epoch + timedelta(seconds=b + 86400)).year + 1):
                    rows.append((zone, year, a, b, off))
        yield pd.DataFrame(rows, columns=["zone", "year", "a", "b", "off"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """One row per (zone, year) with the array of offset intervals that touch the year."""
    rows = zones.select(F.col("zone").cast("string").alias("zone")).where("zone is not null").distinct().mapInPandas(
        _explode_zones, "zone string, year int, a bigint, b bigint, off int")
    return rows.groupBy("zone", "year").agg(F.array_sort(F.collect_list(F.struct("a", "b", "off"))).alias("spans"))


DATE_TEMPLATE = r"(?i)\{\{\s*(?:start|end|film|release|launch)?[ -]?(?:date|dts)[^|{}]*\|([^{}]*)\}\}"


def _template(inner: Column, text: Column) -> Column:
    """``{{start date|2020|4|26|df=y}}``, inside ``2020|4|26|df=y``, becomes ``2020-4-26`` (named parameters are skipped); without a template the text stays."""
    parts = F.filter(F.split(inner, r"\s*\|\s*"), lambda p: p.rlike(r"^\d{1,4}$"))
    parts = F.slice(parts, 1, 3)
    return F.when(inner != "", F.array_join(parts, "-")).otherwise(text)


def _groups(col: Column, pattern: str, n: int, order: str | None = None) -> Column:
    """All groups of a whole-text pattern as an array, in one pass."""
    return F.split(F.regexp_replace(col, pattern, order or "|".join(f"${i}" for i in range(1, n + 1))), r"\|")


CLOCK = (r"^(.*?)(?:t|,|\s|\bat\b)*\s*(오전|오후)?\s*(?<![\d:])(\d{1,2})(?::|시\s*)(\d{2})(?:분)?(?:\s*:?\s*(\d{2})(?:초)?(?:[.,]\d{1,9})?)?"
         r"\s*([ap]\.?\s?m\.?)?\s*\(?((?:utc|gmt)?\s?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?\)?\s*$")
COMPACT = r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})?(?:\.\d+)?\s*(z|[+-]\d{2}:?\d{2})?$"
_MON = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
#: (pattern, replacement) to year|month|day|first|second of the day part; first and second are day and month as written.
DAYS = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3||"),
    (r"^(\d{4})\s*[-./년]\s*(\d{1,2})(?:\s*[-./월]\s*(\d{1,2}))?\s*[.월일]?$", "$1|$2|$3||"),
    (r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})$", "$3|||$1|$2"),
    (r"^(?:[a-z]{3,9}\.?,?\s+)??" + _MON + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", "$3|$1|$2||"),
    (r"^(?:[a-z]{3,9}\.?,?\s+)?(\d{1,2})(?:st|nd|rd|th)?\.?\s+(?:of\s+)?" + _MON + r",?\s+(\d{4})$", "$3|$2|$1||"),
    ("^" + _MON + r",?\s+(\d{4})$", "$2|$1|||"),
    (r"^(\d{4})년?$", "$1||||"),
)


def parse(df: DataFrame) -> DataFrame:
    """Add ``_p``: struct (y, mo, d, n1, n2, hh, mi, ss, ap, zone, epoch) of the fields ``text`` states, null where it states none.

    n1 and n2 are day and month in the order written of dates in numbers that end in the year. The
    work goes in steps, each one column, so that no expression is evaluated twice.
    """
    t = decode_char_refs(F.col("text"))
    for pattern in FOOTNOTES:
        t = F.regexp_replace(t, pattern, "")
    x = df.withColumn("_t", t)
    x = x.withColumn("_inner", F.regexp_extract("_t", DATE_TEMPLATE, 1))
    x = x.withColumn("_t", _template(F.col("_inner"), F.col("_t")))
    x = x.withColumn("_t", F.lower(squeeze(F.regexp_replace("_t", r"\((?![^)]*(?i:utc|gmt|[a-z]{2,4}t\)))[^)]*\)|\[[^\]]*\]|'{2,}|<[^>]*>", " "))))
    t = F.col("_t")
    x = x.withColumn("_c", F.when(t.rlike(r"^\d+$"), None).when(t.rlike(COMPACT), _groups(t, COMPACT, 7, "$1-$2-$3||$4|$5|$6||$7"))
                     .when(t.rlike(CLOCK), _groups(t, CLOCK, 7)))
    x = x.withColumn("_day", F.coalesce(F.trim(F.get("_c", 0)), t))
    day, split = F.col("_day"), F.lit(None).cast("array<string>")
    for pattern, to in reversed(DAYS):
        split = F.when(day.rlike(pattern), _groups(day, pattern, 5, to)).otherwise(split)
    x = x.withColumn("_f", split)
    f, c = (lambda i: F.get("_f", i)), (lambda i: F.get("_c", i))
    num = lambda v: v.try_cast("int")
    month = F.coalesce(num(f(1)), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), f(1)), F.lit(0)).cast("int"))
    n = t.try_cast("bigint")
    epoch = (F.when(t.rlike(r"^\d{9,10}$"), n).when(t.rlike(r"^\d{12,13}$"), F.floor(n / 1000).cast("bigint")).when(t.rlike(r"^\d{15,16}$"), F.floor(n / 1_000_000).cast("bigint")))
    return x.withColumn("_p", F.struct(
        num(f(0)).alias("y"), month.alias("mo"), num(f(2)).alias("d"), num(f(3)).alias("n1"), num(f(4)).alias("n2"),
        num(c(2)).alias("hh"), num(c(3)).alias("mi"), F.when(c(2).isNotNull(), F.coalesce(num(c(4)), F.lit(0))).alias("ss"),
        F.regexp_replace(F.concat(c(5), c(1)), r"[.\s]", "").alias("ap"), F.nullif(c(6), F.lit("")).alias("zone"), epoch.alias("epoch"))).drop("_t", "_inner", "_c", "_day", "_f")


def normalise(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add ``norm`` to ``df`` with columns ``text``, ``zone`` (IANA name or null) and ``date_order``.

    ``intervals`` comes from ``zone_intervals``. UTC ``YYYY-MM-DDTHH:MM:SSZ`` for a time of day, else
    ``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY``. Null for null, blank, relative, unknown and impossible
    dates and for a time without a known zone. Rows keep their number; repeated rows stay.
    """
    x = parse(df)
    p = lambda name: F.col(f"_p.{name}")
    order = F.coalesce(F.lower("date_order"), F.lit("mdy"))
    swapped = order == "dmy"
    x = x.withColumns({"_y": p("y"), "_mo": F.coalesce(p("mo"), F.when(swapped, p("n2")).otherwise(p("n1"))),
                       "_d": F.coalesce(p("d"), F.when(swapped, p("n1")).otherwise(p("n2")))})
    hour = (F.when(p("ap").rlike("^(pm|오후)$") & p("hh").between(1, 12), p("hh") % 12 + 12)
            .when(p("ap").rlike("^(am|오전)$") & p("hh").between(1, 12), p("hh") % 12)
            .when(p("ap").rlike("am|pm|오"), F.lit(None)).otherwise(p("hh")))
    full = F.lpad(F.col("_y").cast("string"), 4, "0"), F.lpad(F.col("_mo").cast("string"), 2, "0"), F.lpad(F.col("_d").cast("string"), 2, "0")
    date = F.concat_ws("-", *full).try_cast("date")
    good_month = F.col("_mo").between(1, 12)
    year_ok = F.col("_y").between(1000, 9999)
    local = F.when(hour.between(0, 23) & p("mi").between(0, 59) & p("ss").between(0, 60),
                   F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + p("mi") * 60 + p("ss"))
    x = x.withColumns({"_date": F.when(year_ok & F.col("_d").isNotNull() & F.col("_mo").isNotNull(), date), "_local": local})
    z = p("zone")
    sign = F.when(z.contains("-"), -1).otherwise(1)
    num = r"([+-])(\d{1,2}):?(\d{2})?$"
    numeric = sign * (F.regexp_extract(z, num, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(z, num, 3).try_cast("int"), F.lit(0)) * 60)
    letters = F.try_element_at(F.create_map(*[F.lit(v) for k, m in ZONE_LETTERS.items() for v in (k, m * 60)]), z)
    region = F.lower(F.col("zone"))
    for (where, word), minutes in REGIONAL_LETTERS.items():
        letters = F.when((z == word) & region.startswith(where), F.lit(minutes * 60)).otherwise(letters)
    x = x.withColumns({"_off": F.when(z.isNotNull(), F.coalesce(numeric, letters)), "_bad_zone": z.isNotNull() & numeric.isNull() & letters.isNull()})
    need = F.col("_local").isNotNull() & F.col("_p.zone").isNull()
    x = x.withColumn("_zone", F.when(need, F.col("zone"))).withColumn("_year", F.when(need, _calendar_year(F.year("_date"))))
    ahead = F.when(F.year("_date") > YEARS[1], F.datediff(F.make_date(F.year("_date"), F.lit(1), F.lit(1)), F.make_date("_year", F.lit(1), F.lit(1))).cast("bigint") * 86400).otherwise(0)
    # Spark follows the keys of a join back to the scans and copies each step's column wherever the next step names it: most of the driver's memory
    # for keys made in many steps. It follows none through a generator, here of one row.
    x = x.withColumn("_keys", F.struct("_zone", "_year", (F.col("_local") - ahead).alias("_at"))).drop("_zone", "_year")
    x = x.select("*", F.inline(F.array("_keys"))).drop("_keys")
    spans = intervals.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "spans")
    x = x.join(spans, ["_zone", "_year"], "left")
    inside = F.transform(F.filter("spans", lambda s: (s["a"] <= F.col("_at")) & (F.col("_at") < s["b"])), lambda s: s["off"])
    before = F.transform(F.filter("spans", lambda s: s["b"] <= F.col("_at")), lambda s: s["off"])
    found = F.when(F.size(inside) > 0, F.array_max(inside)).otherwise(F.try_element_at(before, F.lit(-1)))
    instant = F.coalesce(p("epoch"), F.col("_local") - F.coalesce(F.col("_off"), found))
    norm = (F.when(p("epoch").isNotNull() | (p("hh").isNotNull() & F.col("_date").isNotNull() & ~F.col("_bad_zone")),
                   F.date_format(F.timestamp_seconds(instant), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(p("hh").isNotNull(), None)
            .when(F.col("_d").isNotNull(), F.date_format("_date", "yyyy-MM-dd"))
            .when(F.col("_mo").isNotNull(), F.when(good_month & year_ok, F.concat_ws("-", full[0], full[1])))
            .when(year_ok, full[0]))
    return x.withColumn("norm", norm).drop("_p", "_y", "_mo", "_d", "_date", "_local", "_off", "_bad_zone", "_zone", "_year", "_at", "spans")
