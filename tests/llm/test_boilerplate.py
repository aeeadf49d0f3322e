import itertools
import random

from lexiloom.llm import boilerplate
from lexiloom.llm.boilerplate import Template, frame, frame_lines, lines_of, page_lines, simple_tree_matching, templates, with_varying


def brute(page, template):
    best = 0
    for k in range(min(len(page), len(template)), -1, -1):
        for a in itertools.combinations(range(len(page)), k):
            for b in itertools.combinations(range(len(template)), k):
                if all(page[i] == template[j] for i, j in zip(a, b)):
                    return k
    return best


def test_matching_is_largest():
    rnd = random.Random(1)
    for _ in range(150):
        p, t = ([rnd.randint(0, 3) for _ in range(rnd.randint(0, 6))] for _ in range(2))
        assert simple_tree_matching(p, t) == brute(p, t)


def test_frame(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, truth = [], {}
    for i in range(60):
        for host in ("one", "two"):
            title = f"{word()} {word()} review"
            paras = [f"{word()} {word()} {word()} {word()} {word()} went home." for _ in range(4)]
            head = ["Menu", "Home About Shop"] if host == "one" else ["Skip to content", "Home | Cast"]
            tail = ["Share this:", "Related posts", f"{word()} ep {i}", f"(c) {host.title()} 20{i % 10 + 10}"]
            short = f"Then, {word()}."
            lines = head + ["", title, paras[0]] + ([f"Photo gallery ({i} images)"] if i % 3 == 0 else []) + paras[1:3] + [short] + [paras[3]] + tail
            key = i * 2 + (host == "two")
            text = "\n".join(lines)
            rows.append((key, f"data-extracted/{'www.' if i % 2 else ''}{host}.example/{host}_{'_'.join(title.split())}_{i}.txt", f"{host.upper()}.example" if i % 5 else None, text, "x"))
            keep = {title, short, *paras}
            truth[key] = {n for n, x in enumerate(lines, 1) if x and x not in keep}
    rows += [(900, "data-extracted/one.example/one_a_1.txt", "one", None, "x"), (901, None, None, " \n ", "x"), (902, None, None, "alone", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, path string, domain string, text string, line_no string")
    got = {}
    for r in frame_lines(df).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert {k: got.get(k, set()) for k in truth} == truth
    assert 900 not in got and 901 not in got
    assert frame_lines(df.limit(0)).count() == 0


def _six_hosts(size):
    """Pages of six hosts: a remark inside articles (by chance on 9 % of the pages of one host, else 1 %), a widget there (5 %) and a notice at the top (2 %)."""
    rnd = random.Random(size)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, remarks, widgets = [], set(), set()
    for h in range(6):
        for i in range(100 * size):
            title = f"{word()} {word()} review"
            paras = [f"{word()} {word()} {word()} {word()} {word()} went home." for _ in range(5)]
            key = len(rows)
            notice = ["Our cookies stay small, fine"] if i % 50 == 0 else []
            inside = []
            if i % 100 < (9 if h == 0 else 1):
                inside, at = [f"{i} years later…"], remarks
            elif i % 20 == 11:
                inside, at = ["Advertisement"], widgets
            lines = ["Menu", *notice, title, paras[0], paras[1], *inside, *paras[2:], "Related posts", f"(c) Host {h}"]
            if inside:
                at.add((key, lines.index(inside[0]) + 1))
            rows.append((key, f"data-extracted/h{h}.example/h{h}_{'_'.join(title.split())}_{i}.txt", f"h{h}.example", "\n".join(lines)))
    return rows, remarks, widgets


def test_constant_nodes_of_the_same_hosts_at_two_sizes(spark):
    for size in (1, 4):
        rows, remarks, widgets = _six_hosts(size)
        df = spark.createDataFrame(rows, "page_id bigint, path string, domain string, text string")
        got = {(r.page_id, r.line_no) for r in frame_lines(df).collect()}
        assert not remarks & got and widgets <= got
        label = lines_of("Our cookies stay small, fine")[0][1]
        nodes = templates(with_varying(page_lines(df))).collect()
        assert len(nodes) == 6 and all(any(x.label == label and x.region == "head" for x in r.nodes) for r in nodes)


def _page(text):
    found = list(map(list, zip(*lines_of(text))))
    return dict(zip(("line_no", "label", "prefix", "varying", "size", "words"), found))


def _node(text, region):
    x = lines_of(text)[0]
    return {"label": x[1], "region": region, "words": x[5] if region == "head" else None}


TREE = [_node(t, r) for t, r in (("Menu", "head"), ("Home » Shop » Cast » News", "head"), ("Cast", "head"), ("Tags", "foot"), ("Recent posts", "foot"), ("(c) One 2020", "foot"), ("Photo gallery (3 images)", "slot"))]
PARA = "The whole village walks home late and nobody says a word about it."


def test_alignment_decides_by_place():
    text = "\n".join(["Menu", "Home » Shop", "A title", PARA, "Cast", "Photo gallery (9 images)", PARA, "Tags", PARA, "So long", "Recent posts", "Another title", "Tags", "(c) One 2021"])
    assert frame(_page(text), Template(TREE)) == [1, 2, 6, 11, 12, 13, 14]


def test_pages_without_article_are_frame():
    assert frame(_page("Menu\nHome » Shop » Cast\nTags\nRecent posts\nA title – Ep. 3\n(c) One 2021"), Template(TREE)) == [1, 2, 3, 4, 5, 6]
    assert frame(_page("Menu\nA short title\nThen, moth.\nRecent posts\nAnother one\n(c) One 2021"), Template(TREE)) == [1, 4, 5, 6]


def test_without_matching_the_result_breaks(monkeypatch):
    text = "Menu\nHome » Shop\nA title\n" + PARA + "\nTags\nAnother title\n(c) One 2021"
    assert frame(_page(text), Template(TREE)) == [1, 2, 5, 6, 7]
    monkeypatch.setattr(boilerplate, "matched", lambda lines: [0] * (len(lines) + 1))
    assert frame(_page(text), Template(TREE)) != [1, 2, 5, 6, 7]


def test_other_scripts(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("春夏秋冬山川海空星月雨雪") for _ in range(6))
    rows, truth = [], set()
    for i in range(80):
        lines = ["メニュー", "ホーム・番組・俳優", word()] + [f"{word()}は{word()}と{word()}を見た。" for _ in range(4)] + ["関連記事", word(), f"全{i}件"]
        truth |= {(i, n) for n in (1, 2, 8, 9, 10)}
        rows.append((i, f"data-extracted/ja.example/ja_{i}.txt", "ja.example", "\n".join(lines)))
    df = spark.createDataFrame(rows, "page_id bigint, path string, domain string, text string")
    assert {(r.page_id, r.line_no) for r in frame_lines(df).collect()} == truth
