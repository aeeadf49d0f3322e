"""Column functions on text, all native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a reader sees it, zero-width signs and no-break spaces included.
BLANKS = r"[\s\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_all(col: Column) -> Column:
    """Trim every kind of white space; null stays null."""
    return F.regexp_replace(col, f"^{BLANKS}+|{BLANKS}+$", "")


def squeeze(col: Column) -> Column:
    """Runs of white space become one blank; both ends are trimmed."""
    return F.trim(F.regexp_replace(col, f"{BLANKS}+", " "))


def _entity_char(code: Column) -> Column:
    """The character of a code point; signs outside Unicode become U+FFFD."""
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def decode_char_refs(col: Column, keep: tuple[str, ...] = ()) -> Column:
    """Decode numeric and named (HTML 4) character references once, natively.

    ``keep`` names references that stay as they are. Unknown names and null stay unchanged.
    """
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() if name not in keep
                           for x in (name, " " if name == "nbsp" else chr(code))],
                         *([] if "apos" in keep else [F.lit("apos"), F.lit("'")]))
    pattern = F.lit(r"(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};|[^&]+|&)")

    def one(atom: Column) -> Column:
        body = F.regexp_replace(atom, r"^&#?[xX]?|;$", "")
        return (F.when(atom.rlike(r"^&#[0-9]+;$"), _entity_char(body.cast("bigint")))
                .when(atom.rlike(r"^&#[xX][0-9a-fA-F]+;$"), _entity_char(F.conv(body, 16, 10).cast("bigint")))
                .when(atom.rlike(r"^&[A-Za-z][A-Za-z0-9]*;$"), F.coalesce(F.try_element_at(names, F.regexp_replace(atom, "^&|;$", "")), atom))
                .otherwise(atom))

    return let(col, lambda v: F.when(F.instr(v, "&") > 0, F.array_join(F.transform(F.regexp_extract_all(v, pattern, F.lit(1)), one), "")).otherwise(v))


#: Patterns that vanish with their content: comments, references, footnote templates.
FOOTNOTES = [
    r"(?s)<!--.*?-->",
    r"(?is)<ref\b[^>]*/>",
    r"(?is)<ref\b[^>]*>.*?</ref\s*>",
    r"(?i)\{\{\s*(?:citation needed|cn|fact|efn|refn|sfn|r|note|clarify|better source needed|unreliable source\??)\b[^{}]*\}\}",
    r"\\footnote\{[^{}]*\}",
    r"\[\^[^\]\s]+\]",
    r"(?i)<sup\b[^>]*>\s*\[[^\]]*\]\s*</sup>",
]
#: Patterns of which a part stays: (pattern, replacement).
UNWRAP = [
    (r"(?i)\{\{\s*(?:nowrap|nobr|small|nobold|big|abbr|ill|interlanguage link|lang\|[a-z-]{2,8}|transl\|[a-z-]{2,8})\s*\|([^{}|]*)(?:\|[^{}]*)?\}\}", "$1"),
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"),
    (r"!?\[([^\[\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)", "$1"),
    (r"\[(?:https?:)?//[^\s\]]+\s+([^\]]*)\]", "$1"),
    (r"(?i)</?(?:b|i|u|s|em|strong|small|big|span|sup|sub|a|font|nowiki|abbr|cite|q|mark|del|ins|p|div)\b[^>]*>", ""),
    (r"\\(?:textbf|textit|emph|text|underline|textsc)\{([^{}]*)\}", "$1"),
    (r"'{2,5}", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"(?<![\w_])__([^_]+)__(?![\w_])", "$1"),
    (r"~~", ""),
    (r"(?<![`])`([^`]+)`(?![`])", "$1"),
]


def strip_inline_markup(col: Column) -> Column:
    """Remove footnotes and comments and unwrap links and emphasis; lists and line breaks stay. Texts without any of their signs skip the rules."""
    def stripped(v: Column) -> Column:
        for pattern in FOOTNOTES:
            v = F.regexp_replace(v, pattern, "")
        for pattern, to in UNWRAP:
            v = F.regexp_replace(v, pattern, to)
        return v

    return let(col, lambda v: F.when(v.rlike(r"[<{\\\[*_~`]|''"), stripped(v)).otherwise(v))
