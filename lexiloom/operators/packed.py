"""Several values packed in one field: one row per value with its position.

Method: the text is cut into atoms (quoted runs, bracketed runs, delimiters, ordinary runs). A
delimiter skeleton masks every ordinary run by one letter for its shape, so the number of distinct
skeletons follows the number of writing styles, not of rows. Splitting rules are resolved once per
distinct (field, skeleton) and joined back; values are then taken out by position with native array
functions.

Most delimiters split wherever they stand. A comma may belong to the value, and its skeleton decides:
the pieces around the commas of a stretch are grouped into the most probable sequence of values,
where a group's probability is its share among the stretches that stand alone between other
delimiters, over all rows of the field. So ``w,u`` is one value if such titles are seen whole
(``A B, C / D E``), two if only its parts are. Where the rows say nothing, a weak prior speaks: a lone
word is seldom a title or a person. Of lone words those that open values (``Hello, A B``) are told
from the others by the same stretches.

Scale: the fields are parsed once and written to the checkpoint folder; statistics and extraction
read them there. Counts combine before the shuffle. Collected are only the shapes of at most
``MOST_COMMAS`` commas (at most 7 + 49 + 343 a field) and opening words (at most 1 / OPENER_SHARE a
field). The rules join without a hint: the adaptive planner broadcasts them only if they are small.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import BLANKS, decode_char_refs, let, strip_inline_markup, trim_all
from lexiloom.runtime import cut

#: Fields whose values are persons: "&" and "and" part them; single words are seldom names.
PERSON_FIELDS = ("starring",)
#: Fields whose values are titles: single words are seldom titles.
TITLE_FIELDS = ("alt_name",)
#: Most commas of one value; share of a field's evidence and of a word's own from which a lone word opens values.
MOST_COMMAS, OPENER_SHARE, OPENER_PURITY = 2, 1 / 200, 0.9
#: Weight of the prior in rows, and its shares of single shapes and of shapes with a comma.
PRIOR_ROWS = 0.1
PRIOR = {"title": {"w": 0.4, "k": 0.4, "a": 0.1, "x": 0.05, "u": 0.02, "h": 0.01, "u,w": 0.02, "w,u": 0.02, "h,w": 0.02},
         "person": {"w": 0.45, "k": 0.4, "a": 0.05, "x": 0.05, "u": 0.02, "h": 0.01, "u,u": 0.02},
         "other": {"u": 0.5, "w": 0.25, "k": 0.15, "a": 0.05, "x": 0.05, "h": 0.01}}
UNSEEN = 1e-6

ATOMS = (
    r"(?s)(\"(?:[^\"\\]|\\.|\"\")*\"|\u201c[^\u201d]*\u201d|\([^()]*\)|\uff08[^\uff09]*\uff09"
    r"|\n|,|;|\||\u3001|\uff0c|\uff1b|\u2022|[ \t]\u00b7[ \t]|[ \t]/(?=[ \t]|$)|/[ \t]| & | and (?=\S)"
    r"|(?:(?!/[ \t]|[ \t]/(?:[ \t]|$)|[ \t]\u00b7[ \t]| & | and \S)[^\"\u201c(\uff08\n,;|\u3001\uff0c\uff1b\u2022])+|.)"
)
#: Delimiter atoms as they stand in a skeleton.
DELIMITERS = {"\n": "N", ",": ",", ";": ";", "|": "|", "\u3001": "d", "\uff0c": "c", "\uff1b": "s", "\u2022": "o", "\u00b7": "m", "/": "/", "&": "&", "and": "+"}
SPLIT = "\u0001"


def _prepare(col: Column) -> Column:
    """List markup becomes line breaks, inline markup goes, character references are decoded."""
    col = strip_inline_markup(decode_char_refs(col, keep=("lt", "gt", "quot")))
    col = F.regexp_replace(col, r"(?i)<br\s*/?>|<li\b[^>]*>|<hr\s*/?>|\\\\(?=\s)", "\n")
    col = F.regexp_replace(col, r"(?i)</?(?:ul|ol|li|dl|dd|dt|table|tr|td)\b[^>]*>", "")
    col = F.regexp_replace(col, r"\\(?:begin|end)\{(?:itemize|enumerate)\}|\\item\b", "\n")
    col = F.regexp_replace(col, r"(?i)^\s*\{\{\s*(?:plain ?list|flat ?list|h ?list|ubl|ubil|ub|unbulleted list|bulleted list|pl|cslist|comma separated entries)\s*\|?", "")
    col = F.regexp_replace(col, r"\}\}\s*$", "")
    col = F.regexp_replace(col, r"(?s)^\s*\[\s*(\".*\"|'.*')?\s*\]\s*$", "$1")
    col = F.regexp_replace(col, r"(?m)^[ \t]*[*#\u2022]+[ \t]*|^[ \t]*[-\u2013][ \t]+", "")
    return decode_char_refs(F.regexp_replace(col, r"\r\n?", "\n"), keep=("quot",))


def _mask(atom: Column) -> Column:
    """One skeleton letter for an atom: a delimiter, Q quoted, p in brackets, _ blank, a lone word u, several w, k in unspaced or Korean script, a capitals and digits, x other."""
    bare = trim_all(atom)
    out = F.when(atom.rlike(r"(?s)^[\"\u201c]."), F.lit("Q")).when(atom.rlike(r"^[(\uff08]"), F.lit("p"))
    out = out.when(atom == "\n", F.lit("N"))
    for sign, mark in DELIMITERS.items():
        if sign != "\n":
            out = out.when(bare == sign, F.lit(mark))
    return (out.when(bare == "", F.lit("_"))
            .when(bare.rlike(r"[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"), F.lit("k"))
            .when(bare.rlike(r"^[\p{Lu}\p{N}]+$"), F.lit("a"))
            .when(bare.rlike(r"^\p{L}[\p{L}\p{M}'\u2019-]*$"), F.lit("u"))
            .when(bare.rlike(r"\p{L}"), F.lit("w")).otherwise(F.lit("x")))


def hard(field: str) -> str:
    """Letters of the delimiters that split a field's texts wherever they stand."""
    return "N;|dcsom/" + ("&+" if field in PERSON_FIELDS else "")


def _shape(letters: str) -> str:
    """One letter for a piece of several atoms; Q if a part is quoted, empty for a blank one."""
    solid = letters.replace("_", "").replace("p", "")
    if "Q" in letters:
        return "Q"
    if not solid:
        return "x" if "p" in letters else ""
    return solid if len(solid) == 1 and solid in "wukahx" else "k" if set(solid) == {"k"} else "w"


def stretches(field: str, skeleton: str) -> list[tuple[list[int], list[str]]]:
    """(places of the commas, shapes of the pieces around them) of each stretch between hard delimiters."""
    out, commas, pieces, at = [], [], [""], hard(field)
    for i, c in enumerate(skeleton):
        if c in at:
            out.append((commas, [_shape(p) for p in pieces]))
            commas, pieces = [], [""]
        elif c == ",":
            commas.append(i)
            pieces.append("")
        else:
            pieces[-1] += c
    out.append((commas, [_shape(p) for p in pieces]))
    return out


def evidence(field: str, skeleton: str) -> list[str]:
    """Shapes of the stretches that a skeleton shows whole: those beside a hard delimiter, with at most MOST_COMMAS commas."""
    if not any(c in hard(field) for c in skeleton):
        return []
    return [",".join(p) for _, p in stretches(field, skeleton) if len(p) <= MOST_COMMAS + 1 and all(p) and "Q" not in p]


def resolve_skeleton(field: str, skeleton: str, seen: dict[str, int]) -> str:
    """The skeleton with 1 at each delimiter that splits, else 0; ``seen`` counts the field's evidence."""
    prior = PRIOR["person" if field in PERSON_FIELDS else "title" if field in TITLE_FIELDS else "other"]
    total = sum(seen.values()) + PRIOR_ROWS

    def cost(pieces: list[str]) -> float:
        if len(pieces) > 1 and ("Q" in pieces or "" in pieces):
            return math.inf
        shape = ",".join(pieces)
        return 0.0 if shape in ("Q", "") else -math.log((seen.get(shape, 0) + PRIOR_ROWS * prior.get(shape, UNSEEN)) / total)

    marks = ["1" if c in hard(field) else "0" for c in skeleton]
    for commas, pieces in stretches(field, skeleton):
        best, back = [0.0], [0]
        for j in range(1, len(pieces) + 1):
            # of equal sequences the one with more values
            c, i = min((best[i] + cost(pieces[i:j]), -i) for i in range(max(0, j - MOST_COMMAS - 1), j))
            best.append(c)
            back.append(-i)
        j = len(pieces)
        while j:
            j = back[j]
            if j:
                marks[commas[j - 1]] = "1"
    return "".join(marks)


def _openers(atoms: DataFrame) -> dict[str, list[str]]:
    """Lone words that open values with a comma, of each field: at most 1 / OPENER_SHARE."""
    mark = lambda i: F.get(F.col("marks"), i)
    edge = lambda i: mark(i).isNull() | F.instr(F.lit(hard("")), mark(i)).cast("boolean")

    def role(i: Column) -> Column:
        whole = (mark(i) == ",") & edge(i - 2) & edge(i + 2)
        return (F.when(whole & (mark(i - 1) == "u") & (mark(i + 1) == "w"), F.struct(trim_all(F.get("atoms", i - 1)).alias("word"), F.lit(1).alias("opens")))
                .when(whole & (mark(i - 1) == "w") & (mark(i + 1) == "u"), F.struct(trim_all(F.get("atoms", i + 1)).alias("word"), F.lit(0).alias("opens"))))

    rows = atoms.where(F.array_contains("marks", ",") & F.arrays_overlap("marks", F.array(*map(F.lit, hard("")))))
    found = rows.select("field", F.explode(F.array_compact(F.transform(F.sequence(F.lit(0), F.size("marks") - 1), role))).alias("r"))
    words = found.groupBy("field", "r.word").agg(F.count("*").alias("n"), F.sum("r.opens").alias("opens"))
    total = words.groupBy("field").agg(F.sum("n").alias("total"))
    kept = words.join(total, "field").where((F.col("opens") >= OPENER_PURITY * F.col("n")) & (F.col("n") >= OPENER_SHARE * F.col("total")))
    out: dict[str, list[str]] = {}
    for r in kept.select("field", "word").orderBy("field", "word").collect():
        out.setdefault(r["field"], []).append(r["word"])
    return out


def _opened(words: list[str]) -> Column:
    """The skeleton with h for the lone words that open values."""
    return F.array_join(F.transform("marks", lambda m, i: F.when((m == "u") & trim_all(F.get("atoms", i)).isin(*words), F.lit("h")).otherwise(m)), "")


def _shapes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, x, n) for f, s, n in zip(pdf["field"], pdf["skeleton"], pdf["n"]) for x in evidence(f, s)]
        yield pd.DataFrame(rows, columns=["field", "shape", "n"]).groupby(["field", "shape"], as_index=False).sum()


def splitting_rules(skeletons: DataFrame) -> DataFrame:
    """(field, skeleton, cuts) of distinct skeletons (field, skeleton, n)."""
    seen: dict[str, dict[str, int]] = {}
    for r in skeletons.mapInPandas(_shapes, "field string, shape string, n bigint").groupBy("field", "shape").agg(F.sum("n").alias("n")).collect():
        seen.setdefault(r["field"], {})[r["shape"]] = r["n"]

    def resolve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cuts=[resolve_skeleton(f, s, seen.get(f, {})) for f, s in zip(pdf["field"], pdf["skeleton"])])

    return skeletons.select("field", "skeleton").mapInPandas(resolve, "field string, skeleton string, cuts string")


def unpack(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows ``(key, field, pos, val)``, one for each value of each non-blank field.

    Null, empty and all-delimiter texts give no row; empty pieces don't count; repeated values keep
    their own positions; columns other than ``key`` and ``fields`` are not read.
    """
    long = df.select(F.col(key).alias("_key"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])).alias("_f"))
    long = long.select("_key", "_f.field", "_f.raw").where(F.col("raw").rlike(r"\S"))
    atoms = long.select("_key", "field", F.regexp_extract_all(_prepare(F.col("raw")), F.lit(ATOMS), F.lit(1)).alias("atoms"))
    atoms = cut(atoms.select("*", F.transform("atoms", _mask).alias("marks")))
    skeleton = F.array_join("marks", "")
    for field, words in _openers(atoms).items():
        skeleton = F.when(F.col("field") == field, _opened(words)).otherwise(skeleton)
    atoms = atoms.select("_key", "field", "atoms", skeleton.alias("skeleton"))
    rules = splitting_rules(cut(atoms.groupBy("field", "skeleton").agg(F.count("*").alias("n"))))
    joined = atoms.join(rules, ["field", "skeleton"])
    piece = lambda atom, i: F.when(F.substring(F.col("cuts"), i + 1, F.lit(1)) == "1", F.lit(SPLIT)).otherwise(atom)
    pieces = F.split(F.array_join(F.transform("atoms", piece), ""), SPLIT)
    pieces = F.filter(F.transform(pieces, _value), lambda v: v != "")
    return joined.select(F.col("_key").alias(key), "field", F.posexplode(pieces).alias("pos", "val")).select(
        key, "field", (F.col("pos") + 1).cast("int").alias("pos"), "val")


def _value(piece: Column) -> Column:
    """A piece as a reader sees it: trimmed, without enclosing quotes."""
    def unquoted(v: Column) -> Column:
        csv = v.rlike(r"(?s)^\"(?:[^\"\\]|\\.|\"\")*\"$")
        inner = F.regexp_replace(F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("\"\""), F.lit("\"")), r"\\([\"\\/])", "$1")
        other = F.regexp_replace(v, r"(?s)^\u201c([^\u201c\u201d]*)\u201d$|^\u2018([^\u2018\u2019]*)\u2019$|^'([^']*)'$|^\u300c([^\u300c\u300d]*)\u300d$|^\u300e([^\u300e\u300f]*)\u300f$", "$1$2$3$4$5")
        return F.when(csv, inner).otherwise(other)

    v = let(F.regexp_replace(trim_all(piece), r"^(?i:and|&)\s+(?=\S)", ""), unquoted)
    return F.regexp_replace(decode_char_refs(trim_all(v)), f"{BLANKS}+", " ")
