from pyspark.sql import functions as F

from lexiloom.llm.markup import clean, elements

CASES = [
    ("== A ==\ntext", {"heading"}), ("### A ###\nx", {"heading"}), ("Part One\n------\nx", {"heading"}), ("<h2>A</h2>", {"heading"}), ("\\subsection*{A}\nx", {"heading"}),
    ("* a\n* b", {"list"}), ("# a\n# b", {"list"}), ("- a\n- b", {"list"}), ("1. a\n2. b", {"list"}), ("<ul><li>a</li></ul>", {"list"}), ("{{plainlist|\n* a\n* b\n}}", {"list"}), ("{{ubl|a|b}}", {"list"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"list"}),
    ("```\nx = [1]\n# c\n```", {"code"}), ("Read `a_b_c` now.", {"code"}), ("<pre><code>10 GOTO 40</code></pre>", {"code"}), ("The \\verb|rm -rf x| twice.", {"code"}), ("\\begin{verbatim}\nfor ep:\n\\end{verbatim}", {"code"}), ("<syntaxhighlight lang=\"text\">a\n b</syntaxhighlight>", {"code"}),
    ("On <math>x^2</math>.", {"formula"}), ("On $x^2 + y^2 = 16$ in chalk.", {"formula"}), ("$$3\\sqrt{2}$$", {"formula"}), ("We read \\(E_n\\) here", {"formula"}), ("\\begin{equation}\nr\n\\end{equation}", {"formula"}), ("$39.1 \\times 10^{9}$ won", {"formula"}),
    ("**$3 \\times 10^{9}$ won**", {"formula", "inline"}), ("a&nbsp;b", {"inline"}), ("[[A|B]] lies", {"inline"}), ("See [A](/b).", {"inline"}), ("~~Old.~~", {"inline"}), ("_By dawn_", {"inline"}), ("``Again,'' he", {"inline"}), ("> quoted", {"inline"}), ("x<!-- y -->", {"inline"}), ("A<br/>B", {"inline"}), ("{{US$|9 million}}", {"inline"}), ("'''A'''", {"inline"}),
    ("* '''a'''\n* b", {"list", "inline"}),
    ("For n > 4 it, n < 4 guests", set()), ("Hearts <3 are", set()), ("from $5 to $90 a week", set()), ("3 * 2 * 1 on", set()), ("2_1 | 0_3 at", set()), ("C:\\scenes\\draft_two.", set()), ("max_of_{three}.", set()), ("The R&B station", set()), ("was #1 in its slot", set()), ("I dont know [sic]", set()), ("— And then? — Then", set()), ("", set()), (None, set()),
]


def test_elements(spark):
    df = spark.createDataFrame([(i, c[0], "elem") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "elem")], "rec_id bigint, synopsis string, elem string")
    got = {}
    for r in elements(df, "rec_id", ("synopsis",)).distinct().collect():
        got.setdefault(r.rec_id, set()).add(r.elem)
    assert {CASES[i][0]: got.get(i, set()) for i in range(len(CASES))} == dict(CASES)
    assert elements(df.limit(0), "rec_id", ("synopsis",)).count() == 0


def test_clean(spark):
    cases = {"== A ==\n* b\n* [[C|D]]": "# A\n- b\n- D", "<h2>A</h2><p>b &amp; c</p>": "# A\nb & c", "Use `x_y_z` and $a_b$ **now**": "Use `x_y_z` and $a_b$ now", "```\na * b\n```": "```\na * b\n```", None: None, "": "", "plain n < 4": "plain n < 4"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select(clean(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == list(cases.values())
    long = "word " * 50_000 + "**x**"
    assert spark.createDataFrame([(long,)], "t string").select(clean(F.col("t")).alias("c")).first().c == "word " * 50_000 + "x"


def test_formulas_and_headings_of_any_length(spark):
    body = "x_{1} + **y** * " * 700 + "z"
    lines = "x_{1} + **y** * \n" * 700 + "z"
    heading = "A long title " * 20
    cases = [(f"$${body}$$", {"formula"}), (f"$${lines}$$", {"formula"}), (f"\\[{lines}\\]", {"formula"}), (f"\\({body}\\)", {"formula"}), (f"${body}$", {"formula"}), ("$$" + lines.replace("\n", "\n\n") + "$$", {"formula"}), (f"\\[a\n\n{lines}\\]", {"formula"}), (f"{heading}end\n------\nx", {"heading"})]
    assert all(len(c[0]) > 10_000 for c in cases[:7])
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "rec_id bigint, synopsis string")
    got = {}
    for r in elements(df, "rec_id", ("synopsis",)).collect():
        got.setdefault(r.rec_id, set()).add(r.elem)
    assert got == {i: c[1] for i, c in enumerate(cases)}
    texts = [r.c for r in df.orderBy("rec_id").select(clean(F.col("synopsis")).alias("c")).collect()]
    assert all(t.count("x_{1} + **y** *") == 700 for t in texts[:7]) and texts[7] == f"# {heading}end\nx"
