"""Quantities written in different units and scales, converted to common units.

Method, pure SQL: regular expressions take out number, scale and unit text; aliases of currencies and
scales become codes and powers by joins with alias tables; unit text, sign and source default are
coalesced; factor and rate are applied in decimal arithmetic. A duration has any number of parts in one
row, so its unit aliases are looked up in a constant map instead. All steps are Spark SQL over the
input; the alias tables are constants and broadcast, nothing else moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import decode_char_refs, squeeze, strip_inline_markup

#: Currency as written -> code.
CURRENCY_ALIASES = {
    "us$": "USD", "usd": "USD", "us dollar": "USD", "us dollars": "USD", "dollar": "USD", "dollars": "USD", "$": "USD", "달러": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "유로": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "pound sterling": "GBP", "pounds sterling": "GBP",
    "cn¥": "CNY", "cny": "CNY", "rmb": "CNY", "yuan": "CNY", "元": "CNY", "人民币": "CNY", "위안": "CNY",
    "jpy": "JPY", "jp¥": "JPY", "yen": "JPY", "円": "JPY", "¥": "JPY", "엔": "JPY",
    "₩": "KRW", "krw": "KRW", "won": "KRW", "sk won": "KRW", "korean won": "KRW", "원": "KRW", "w": "KRW", "억": "KRW", "조": "KRW",
}
#: Scale as written -> power of ten.
SCALES = {
    "trillion": 12, "tn": 12, "조": 12, "billion": 9, "bn": 9, "bil": 9, "b": 9, "million": 6, "mil": 6, "mio": 6, "mn": 6, "m": 6,
    "thousand": 3, "k": 3, "억": 8, "億": 8, "亿": 8, "천만": 7, "백만": 6, "만": 4, "万": 4, "萬": 4, "천": 3,
}
#: Unit of time as written -> milliseconds.
TIME_UNITS = {
    "ms": 1, "millisecond": 1, "msec": 1, "s": 1000, "sec": 1000, "second": 1000, "초": 1000, "″": 1000, "''": 1000, '"': 1000,
    "m": 60_000, "min": 60_000, "minute": 60_000, "분": 60_000, "′": 60_000, "'": 60_000,
    "h": 3_600_000, "hr": 3_600_000, "hour": 3_600_000, "시간": 3_600_000, "d": 86_400_000, "day": 86_400_000, "일": 86_400_000,
}
_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _lookup(values: dict[str, object], key: Column, kind: str) -> Column:
    """Alias to unit inside an array: a constant map, the in-row form of a join with an alias table."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), key)


def _alternatives(words: object) -> str:
    special = set("$.|?*+()[]{}^\\")
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in sorted(words, key=len, reverse=True))


def _replace(col: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        col = F.regexp_replace(col, pattern, to)
    return col


def _number(text: Column) -> Column:
    """Decimal of a number with blanks, commas or dots as thousand marks and comma or dot as decimal mark."""
    t = F.regexp_replace(text, r"[\s\u00a0]", "")
    t = (F.when(t.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(t, F.lit(","), F.lit("")))
         .when(t.rlike(r"^\d{1,3}(\.\d{3}){2,}(,\d+)?$") | t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
         .otherwise(F.replace(t, F.lit(","), F.lit("."))))
    return t.try_cast("decimal(30,6)")


NUM = r"\d+(?:[.,]\d+)*"
_SCALE = r"(?:\s*(?:" + _alternatives(SCALES) + r")(?![a-z])\.?)?"
_CUR = _alternatives(CURRENCY_ALIASES)
#: Words that leave an amount as it is.
HEDGES = r"(?<![a-z])(?:about|around|over|under|approx|approximately|circa|ca|c|est|estimated|nearly|almost|roughly|some|more than|less than|up to|at least|between|from)(?![a-z])"


def _amount_text(col: Column) -> Column:
    """Budget text in lower case with markup, hedges and notes gone and powers of ten written as e-notation."""
    t = decode_char_refs(col)
    t = _replace(t, (r"(?i)\{\{\s*(us\$|usd|krw|sk ?won|won|eur|euro|gbp|jpy|cny|rmb|\u20a9|\u20ac|\u00a3)\s*\|([^{}|]*)(?:\|[^{}]*)?\}\}", " $1 $2 "))
    t = F.lower(strip_inline_markup(t))
    power = r"\s*(?:\\times|\\cdot|\u00d7|x|\*)\s*10\s*\^\s*\{?(\d+)\}?"
    t = _replace(t, (r"\\[()\[\]]", " "), (r"\$(" + NUM + r")" + power + r"\s*\$", " $1e$2 "), (r"(" + NUM + r")" + power, " $1e$2 "))
    t = _replace(t, (r"<[^>]*>", " "), (r"[\u2013\u2014~\u301c\uff5e-]", "-"), (r"\s*-\s*", "-"))
    return squeeze(t)


def budgets(df: DataFrame, key: str, field: str, rates: DataFrame, default: str | None = None) -> DataFrame:
    """Rows ``(key, field, unit, low, high)`` of amounts in won.

    ``rates`` (currency, krw_per_unit) joins on the currency code; of repeated codes the highest rate
    counts. An amount without a currency or any other word is in ``default``, the source's currency; without one, or
    without an amount, beyond the range of bigint, or with null or blank text: no row.
    """
    rate = rates.groupBy(F.upper("currency").alias("cur")).agg(F.max("krw_per_unit").cast("decimal(10,0)").alias("rate"))
    per = r"per[ -]episode|an episode|each episode|a episode|/ ?ep(?:isode)?\b\.?|\bper ep\b\.?|회당|편당|每集"
    t = _amount_text(F.col(field))
    x = df.select(key, t.alias("t")).where(F.col("t").rlike(r"\d"))
    x = x.select(key, F.col("t").rlike(per).alias("per"), F.regexp_replace("t", per, " ").alias("t"))
    sign = r"(?:" + _CUR + r")"
    one = r"(?:(" + sign + r")\s*)?(" + NUM + r"(?:e\d+)?)(" + _SCALE + r")\s*(" + sign + r"(?![a-z]))?"
    pair = one + r"(?:\s*(?:-|to|and)\s*" + one + r")?"
    g = [F.regexp_extract("t", r"(?:^|[^a-z0-9$\u20a9\u20ac\u00a3.,])" + pair, i) for i in range(1, 9)]
    # only an amount without any other word or sign is in the default currency: "12 zlotys" is not
    bare = ~F.regexp_replace(F.regexp_replace(F.col("t"), pair, " "), HEDGES, " ").rlike(r"[\p{L}\p{Sc}0-9]")
    x = x.withColumn("t", F.concat(F.lit(" "), F.col("t"))).select(key, "per", bare.alias("bare"), *[c.alias(f"g{i + 1}") for i, c in enumerate(g)])
    x = x.where("g2 <> ''")

    # aliases meet their tables in joins; the tables are constants, so they are broadcast
    aliases, scales = (df.sparkSession.createDataFrame(sorted(t.items()), f"alias string, value {kind}") for t, kind in ((CURRENCY_ALIASES, "string"), (SCALES, "int")))
    for name in ("g1", "g4", "g5", "g8"):
        x = x.join(F.broadcast(aliases.select(F.col("alias").alias(name), F.col("value").alias(f"cur_{name}"))), name, "left")
    for number, name in (("g2", "g3"), ("g6", "g7")):
        x = x.withColumn(f"key_{name}", F.regexp_replace(name, r"[\s.]", "")).join(F.broadcast(scales.select(F.col("alias").alias(f"key_{name}"), F.col("value").alias(f"scale_{name}"))), f"key_{name}", "left")
    power = lambda number, scale: F.coalesce(F.regexp_extract(number, r"e(\d+)$", 1).try_cast("int"), F.col(f"scale_{scale}"))
    cur = F.coalesce(*[F.col(f"cur_{name}") for name in ("g1", "g4", "g5", "g8")], F.when(F.concat("g3", "g7").rlike("억|조"), F.lit("KRW")), F.when(F.col("bare"), F.lit(default).cast("string")))
    low, high = _number(F.regexp_replace("g2", r"e\d+$", "")), _number(F.regexp_replace("g6", r"e\d+$", ""))
    p2, p6 = power("g2", "g3"), power("g6", "g7")
    x = x.select(key, "per", cur.alias("cur"), low.alias("low"), high.alias("high"),
                 F.coalesce(p2, F.when(F.col("g6") != "", p6), F.lit(0)).alias("p2"), F.coalesce(p6, p2, F.lit(0)).alias("p6")).join(rate, "cur")
    scaled = lambda n, p: F.concat(n.cast("string"), F.lit("e"), F.col(p).cast("string")).try_cast("decimal(27,6)")
    won = lambda n, p: F.round(F.try_multiply(scaled(n, p), F.col("rate"))).try_cast("bigint")
    x = x.select(key, F.lit(field).alias("field"), F.when(F.col("per"), "krw_per_episode").otherwise("krw").alias("unit"),
                 won(F.col("low"), "p2").alias("low"), F.coalesce(won(F.col("high"), "p6"), won(F.col("low"), "p2")).alias("high"))
    return x.where(F.col("low").isNotNull())


def _duration_text(col: Column) -> Column:
    """Duration text in lower case with templates opened and number words turned to digits."""
    t = decode_char_refs(col)
    t = F.lower(strip_inline_markup(t))
    t = _replace(t, (r"\{\{\s*(?:duration|hms|ms)\s*\|([^{}]*)\}\}", " $1 "), (r"(?:^|[\s|])([hms])\s*=\s*(" + NUM + r")(?=[\s|]|$)", " $2 $1 "), (r"<[^>]*>", " "))
    t = _replace(t, (r"^\s*p(?:(\d+)d)?t(?:(" + NUM + r")h)?(?:(" + NUM + r")m)?(?:(" + NUM + r")s)?\s*$", " $1 d $2 h $3 m $4 s "), (r"(?:^|\s)(?:d|h|m|s)(?=\s*(?:[dhms]\b|$))(?<!\d\s[dhms])", " "))
    t = _replace(t, (r"\bhalf an hour\b|\ba half[ -]hour\b", " 30 min "), (r"\ba quarter of an hour\b", " 15 min "), (r"\bthree[ -]quarters of an hour\b", " 45 min "),
                 (r"\band a half hours?\b", " hours 30 min "), (r"\bhours? and a half\b", " hour 30 min "), (r"\bhours? and a quarter\b", " hour 15 min "), (r"\ban?\s+hour\b", " 1 hour "), (r"\ba minute\b", " 1 min "))
    for i, word in enumerate(_TENS):
        t = F.regexp_replace(t, rf"\b{word}\b", str(20 + 10 * i))
    for i, word in enumerate(_ONES):
        t = F.regexp_replace(t, rf"\b{word}\b", str(i + 1))
    t = _replace(t, (r"\b([2-9])0[ -]([1-9])\b(?!\s*-)(?=\s*(?:hour|min|sec))", "$1$2"))
    return squeeze(_replace(t, (r"[\u2013\u2014~\u301c\uff5e]", "-"), (r"(\d)\s*(?:-|to)\s*(?=\d)", "$1-")))


_UNIT = r"(ms|msecs?|milliseconds?|h(?:ou)?rs?|h|m(?:in(?:ute)?s?)?|s(?:ec(?:ond)?s?)?|d(?:ays?)?|시간|분|초|일|\u2032|\u2033|''|'|\")"


def durations(df: DataFrame, key: str, field: str) -> DataFrame:
    """Rows ``(key, field, unit, low, high)`` of durations in whole seconds; a bare number is in minutes.

    Texts without a number or number word, null and blank: no row.
    """
    t = _duration_text(F.col(field))
    x = df.select(key, t.alias("t"))
    part = NUM + r"(?:\.\d+)?\s*" + _UNIT.replace("(", "(?:", 1) + r"(?![a-z])"
    ms = lambda n, unit: _number(n) * F.coalesce(_lookup(TIME_UNITS, F.when(F.length(unit) > 2, F.regexp_replace(unit, "s$", "")).otherwise(unit), "bigint"), F.lit(60_000))
    clock = r"(?:^|[^\d:])(\d+):(\d{1,2})(?::(\d{1,2}))?(?![\d:])"
    c = [F.regexp_extract("t", clock, i).try_cast("bigint") for i in (1, 2, 3)]
    short = F.col("t").rlike(r"\(?\bmm:ss\b") | ((c[0] > 4) & ~F.col("t").rlike("hh:mm"))
    clock_s = F.when(c[2].isNotNull(), c[0] * 3600 + c[1] * 60 + c[2]).when(short, c[0] * 60 + c[1]).otherwise(c[0] * 3600 + c[1] * 60)
    hm = r"(?:^|[^a-z\d])(\d+)\s*h\s*(\d{1,2})(?![\d.,]*\s*[a-z분])"
    span = r"(?:^|[^\d.,])(" + NUM + r")-(" + NUM + r")\s*" + _UNIT + r"?(?![a-z])"
    parts = F.regexp_extract_all("t", F.lit(r"(" + part + r")"), F.lit(1))
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,6)"), lambda acc, p: (acc + F.coalesce(
        ms(F.regexp_extract(p, r"^(" + NUM + r")", 1), F.regexp_extract(p, r"\s*" + _UNIT + r"$", 1)), F.lit(0))).cast("decimal(38,6)"))
    bare = F.regexp_extract("t", r"(?:^|[^\d.,:])(" + NUM + r")(?=\s|$)", 1)
    span_unit = F.regexp_extract("t", span, 3)
    sec = lambda v: F.round(v / 1000).cast("bigint")
    is_clock, is_span, is_hm = F.col("t").rlike(clock), F.col("t").rlike(span), F.col("t").rlike(hm)
    hm_s = F.regexp_extract("t", hm, 1).try_cast("bigint") * 3600 + F.regexp_extract("t", hm, 2).try_cast("bigint") * 60
    low = (F.when(is_clock, clock_s).when(is_span, sec(ms(F.regexp_extract("t", span, 1), span_unit))).when(is_hm, hm_s)
           .when(F.size(parts) > 0, sec(total)).otherwise(sec(_number(bare) * 60_000)))
    high = F.when(~is_clock & is_span, sec(ms(F.regexp_extract("t", span, 2), span_unit))).otherwise(low)
    x = x.where(F.col("t").rlike(r"\d")).select(key, F.lit(field).alias("field"), F.lit("second").alias("unit"), low.alias("low"), high.alias("high"))
    return x.where(F.col("low").isNotNull())
