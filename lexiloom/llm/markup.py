"""Markup residue: which sorts of elements a text holds, and its clean form with structure kept.

The text is cut into atoms: code and formulas, which no other rule may look into, and the rest. All
rules are native regular expressions over HTML, wiki, Markdown and LaTeX, so the work is one scan
without shuffles. Signs that only look like markup (``n < 4``, ``$5 to $90``, ``3 * 2``, ``R&B``,
``max_of_{three}``) match no rule.

Aligning the trees of pages of one host can't serve here: records belong to no host and share no
template, and what is asked is the sort of each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import FOOTNOTES, UNWRAP, decode_char_refs

CODE = (
    r"(?is)<(?:pre|syntaxhighlight|source|code|tt|kbd|samp)\b[^>]*>.*?</(?:pre|syntaxhighlight|source|code|tt|kbd|samp)\s*>(?:\s*</(?:pre|code)\s*>)?",
    r"(?ms)^[ \t]*(?:```|~~~)[^\n]*\n.*?^[ \t]*(?:```|~~~)[ \t]*$",
    r"(?s)\\begin\{(?:verbatim|lstlisting|minted)\*?\}.*?\\end\{(?:verbatim|lstlisting|minted)\*?\}",
    r"\\(?:verb|lstinline)\*?([|!+/#@])[^\n]*?\1",
    r"(?<!`)`[^`\n]+`(?!`)(?!')",
)
FORMULA = (
    r"(?is)<(?:math|chem|ce)\b[^>]*>.*?</(?:math|chem|ce)\s*>",
    r"(?s)\\begin\{(?:equation|align|gather|displaymath|math|eqnarray|multline)\*?\}.*?\\end\{(?:equation|align|gather|displaymath|math|eqnarray|multline)\*?\}",
    r"\$\$(?=\s*\S)(?:[^$]++|\$(?!\$))++\$\$",
    r"\\\[(?=\s*\S)(?:[^\\]++|\\(?!\]))++\\\]",
    r"\\\((?=\s*\S)(?:[^\\]++|\\(?!\)))++\\\)",
    r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_={}+])[^$\n]++(?<=[^\s$\\])\$(?![\d$])",
)
HEADING = (
    r"(?i)<h[1-6]\b[^>]*>",
    r"(?m)^[ \t]*(={2,6})[^=\n]+\1[ \t]*$",
    r"(?m)^[ ]{0,3}#{2,6}[ \t]+\S",
    r"(?m)^[^\s\-=*>|#][^\n]*+\n(?:={3,}|-{3,})[ \t]*$",
    r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{",
)
LIST = (
    r"(?i)<(?:ul|ol|li|dl|dt|dd)\b[^>]*>",
    r"(?m)^[ \t]*\*+[ \t]+\S",
    r"(?m)^[ \t]*\*(?![*\s])(?![^*\n]*\*)",
    r"(?m)^[ \t]*[-+\u2022][ \t]+\S",
    r"(?m)^[ \t]*\d{1,2}[.)][ \t]+\S[^\n]*\n+[ \t]*\d{1,2}[.)][ \t]+\S",
    r"(?m)^#[ \t]*[^#\s][^\n]*$",
    r"(?m)^[:;][ \t]*\S",
    r"(?i)\{\{\s*(?:plain ?list|flat ?list|h ?list|ubl|ubil|ub|unbulleted list|bulleted list|ordered list|numbered list|pl|cslist)\s*(?:\||\})",
    r"\\begin\{(?:itemize|enumerate|description)\}|\\item\b",
)
#: Taken out before inline marks are looked for: they only build lists and headings.
BUILDERS = (
    r"(?i)</?(?:ul|ol|li|dl|dt|dd|h[1-6])\b[^>]*>",
    r"(?m)^[ \t]*={2,6}|={2,6}[ \t]*$",
    r"(?m)^[ ]{0,3}#{1,6}[ \t]|[ \t]#{2,6}[ \t]*$",
    r"(?m)^(?:={3,}|-{3,})[ \t]*$",
    r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{[^{}\n]*\}",
    r"(?m)^[ \t]*[*]+[ \t]+",
    r"(?i)\{\{\s*(?:plain ?list|flat ?list|h ?list|ubl|ubil|ub|unbulleted list|bulleted list|ordered list|numbered list|pl|cslist)\s*\|?",
    r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}|\\item\b",
)
INLINE = (
    r"(?i)</?(?:b|i|u|s|em|strong|small|big|span|sup|sub|a|font|nowiki|abbr|cite|q|mark|del|ins|p|div|section|blockquote|br|hr|img|center|table|tr|td|th|ref|references|strike|poem|gallery|figure|figcaption)\b(?:\s[^<>]*)?/?>",
    r"<!--", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});",
    r"''+[^'\n]", r"\*\*(?=\S)[^*\n]+\*\*", r"(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])",
    r"(?s)(?<![\w\\_])_(?=[^\s_])(?:[^_\n]|_(?=\w))*(?<=[^\s_])_(?![\w_{])", r"~~(?=\S)[^~\n]+~~", r"\[\[[^\[\]\n]+\]\]", r"\[[^\[\]\n]*\]\([^()\s]+[^()\n]*\)", r"\[(?:https?:)?//[^\]\s]+[^\]\n]*\]", r"\[\^[^\]\s]+\]",
    r"(?m)^[ ]{0,3}>[ \t]?\S", r"\{\{[^{}\n]+(?:\}\}|\|)",
    r"\\(?:textbf|textit|emph|text|underline|textsc|texttt|footnote|href|url|cite|ref|label|paragraph|quote)\*?\{", r"\\begin\{(?:quote|quotation|center|abstract)\}", r"``[^`'\n]+''", r"(?m)\\\\[ \t]*$",
)

ATOM = "(?s)(" + "|".join(p.replace("(?is)", "(?is:", 1) + ")" if p.startswith("(?is)") else p.replace("(?ms)", "(?ms:", 1) + ")" if p.startswith("(?ms)") else p.replace("(?s)", "(?s:", 1) + ")" if p.startswith("(?s)") else p
                          for p in (CODE[0], CODE[1], CODE[2], r"\\(?:verb|lstinline)\*?\|[^|\n]*\|", CODE[4], *FORMULA)) + ")"


def _any(col: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col.rlike(p)
    return out


def _without(col: Column, patterns: tuple[str, ...], to: str = " ") -> Column:
    for p in patterns:
        col = F.regexp_replace(col, p, to)
    return col


def elements(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows ``(key, field, elem)``, one for each sort of element: heading, list, code, formula, inline.

    Null, blank and plain texts give no row; an element counts once per text however often it occurs.
    """
    long = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])).alias("f"))
    long = long.select(key, "f.field", "f.t").where(F.col("t").rlike(r"[<>&*_`~#=\-\[\]{}\\$'^+\u2022|:;]|\d[.)]\s"))
    x = long.withColumn("t1", _without(F.col("t"), CODE, "x"))
    x = x.withColumn("t2", _without(F.col("t1"), FORMULA, "x"))
    x = x.withColumn("t3", _without(F.col("t2"), BUILDERS))
    found = F.array_compact(F.array(
        F.when(F.col("t") != F.col("t1"), "code"), F.when(F.col("t1") != F.col("t2"), "formula"),
        F.when(_any(F.col("t2"), HEADING), "heading"), F.when(_any(F.col("t2"), LIST), "list"), F.when(_any(F.col("t3"), INLINE), "inline")))
    return x.select(key, "field", F.explode(found).alias("elem"))


def clean(col: Column) -> Column:
    """Text without markup; headings stay as ``# ``, items as ``- ``, code in back quotes or fences, formulas between dollar signs.

    Null stays null, empty stays empty. Whole texts are processed, of any length.
    """
    mark = "\u0001"
    cut = F.regexp_replace(col, ATOM, mark + "$1" + mark)
    atoms = F.split(cut, mark)

    def plain(a: Column) -> Column:
        a = _without(a, tuple(FOOTNOTES), "")
        for p, to in ((r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", "\n\u0002 $1\n"), (r"(?m)^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", "\u0002 $2"),
                      (r"(?m)^[ ]{0,3}#{2,6}[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", "\u0002 $1"), (r"(?m)^([^\s\-=*>|#\u0002][^\n]*+)\n(?:={3,}|-{3,})[ \t]*$", "\u0002 $1"),
                      (r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}", "\u0002 $1"),
                      (r"(?m)^#[ \t]*(?=[^#\s])(?=[^\n]*$)", "- "), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)</li\s*>|</?(?:ul|ol|dl)\b[^>]*>", ""),
                      (r"(?m)^[ \t]*(?:\*+[ \t]*(?![*\s])(?![^*\n]*\*\*)|\d{1,2}[.)][ \t]+|[+\u2022][ \t]+)", "- "), (r"\\item\b[ \t]*", "- "),
                      (r"\\(?:begin|end)\{[a-z*]+\}", ""), (r"(?i)\{\{\s*(?:plain ?list|flat ?list|h ?list|ubl|ubil|unbulleted list|pl)\s*\|?([^{}]*)\}\}", "$1"),
                      (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p\s*>", "\n\n"), (r"(?m)^[ ]{0,3}>[ \t]?", ""), (r"``([^`'\n]+)''", "\"$1\""), (r"(?i)</?blockquote[^>]*>", "")):
            a = F.regexp_replace(a, p, to)
        for p, to in UNWRAP:
            a = F.regexp_replace(a, p, to)
        a = F.regexp_replace(a, r"(?<![\w\\_])_(?=[^\s_])([^_\n]*)(?<=[^\s_])_(?![\w_{])", "$1")
        a = F.regexp_replace(a, r"\{\{[^{}|\n]+(?:\|([^{}|\n]*))?[^{}\n]*\}\}", "$1")
        return F.replace(decode_char_refs(a), F.lit("\u0002"), F.lit("#"))

    def one(a: Column) -> Column:
        code = a.rlike(r"(?s)^(?:<(?i:pre|syntaxhighlight|source|code|tt|kbd|samp)\b|[ \t]*(?:```|~~~)|\\begin\{(?:verbatim|lstlisting|minted)|\\verb|\\lstinline|`[^`])")
        formula = a.rlike(r"(?s)^(?:<(?i:math|chem|ce)\b|\\begin\{(?:equation|align|gather|displaymath|math|eqnarray|multline)|\$|\\\[|\\\().*(?:>|\}|\$|\\\]|\\\))$")
        body = F.trim(F.regexp_replace(F.regexp_replace(a, r"(?is)^(?:<[^>]*>)+|(?:</[^>]*>\s*)+$|^[ \t]*(?:```|~~~)[^\n]*\n|\n?[ \t]*(?:```|~~~)[ \t]*$|\\(?:begin|end)\{[a-z*]+\}|^`|`$", ""), r"^\\(?:verb|lstinline)\*?\||\|$", ""))
        block = (F.instr(body, "\n") > 0) | a.rlike(r"(?i)^(?:[ \t]*(?:```|~~~)|<pre\b|<syntaxhighlight\b|\\begin)")
        math = F.trim(F.regexp_replace(a, r"(?is)^<[^>]*>|</[^>]*>$|\\(?:begin|end)\{[a-z*]+\}|^\$+|\$+$|^\\[\[(]|\\[\])]$", ""))
        return (F.when(code, F.when(block, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("`"), body, F.lit("`"))))
                .when(formula, F.concat(F.lit("$"), math, F.lit("$"))).otherwise(plain(a)))

    out = F.array_join(F.transform(atoms, one), "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+(?=\n)", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
