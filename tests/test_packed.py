from lexiloom.operators import packed
from lexiloom.operators.packed import evidence, resolve_skeleton, unpack

FIELDS = ("alt_name", "starring", "genre")


def names(spark, rows):
    df = spark.createDataFrame(rows, "rec_id bigint, alt_name string, starring string, genre string, field string")
    out = {}
    for r in unpack(df, "rec_id", FIELDS).collect():
        out.setdefault((r.rec_id, r.field), {})[r.pos] = r.val
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


CASES = [
    ("alt_name", "A B / C D", ["A B", "C D"]), ("alt_name", "Suno Ri\n수노 리", ["Suno Ri", "수노 리"]),
    ("alt_name", '["담깨기 슬원", "Damkkaegi Seulwon"]', ["담깨기 슬원", "Damkkaegi Seulwon"]),
    ("alt_name", '"Hello, Narrow Gallery", "A ""B"" C"', ["Hello, Narrow Gallery", 'A "B" C']),
    ("alt_name", "별다 가 / Young Viaduct, Rumor / YV12", ["별다 가", "Young Viaduct, Rumor", "YV12"]),
    ("alt_name", "Hello, Rusted Lamp; &#48120;&#51648;&#49556;", ["Hello, Rusted Lamp", "미지솔"]),
    ("alt_name", "Pasu Ya, EUD21", ["Pasu Ya", "EUD21"]),
    ("alt_name", "{{ubl|A B|''C D''}}", ["A B", "C D"]), ("alt_name", "{{plainlist|\n* A B\n* C D\n}}", ["A B", "C D"]),
    ("starring", "[[A B (actor)|A B]], C D (cameo, ep. 1) and E F<ref name=\"x\">p, 1</ref>", ["A B", "C D (cameo, ep. 1)", "E F"]),
    ("starring", "<ul><li>A B</li><li>[C D](/c/d)</li></ul>", ["A B", "C D"]), ("starring", "A B & C D", ["A B", "C D"]),
    ("starring", "'''A B'''<br/>{{nowrap|C D}}<BR>**E F**", ["A B", "C D", "E F"]),
    ("genre", "Action &amp; adventure, , School,", ["Action & adventure", "School"]), ("genre", "A・B", ["A・B"]), ("genre", "Crime、Legal，School", ["Crime", "Legal", "School"]),
]


def test_cases(spark):
    rows = []
    for i, (f, text, _) in enumerate(CASES):
        rows.append((i, *[text if f == x else None for x in FIELDS], "clash"))
    got = names(spark, rows)
    assert {i: got.get((i, f)) for i, (f, _, _) in enumerate(CASES)} == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_edges(spark):
    long = ", ".join(f"Aaa Bbb{i}" for i in range(5000))
    got = names(spark, [(1, None, "", " , ,", "x"), (2, "  ", long, '""', "x"), (3, "A B, A B", None, None, "x"), (3, "A B, A B", None, None, "x")])
    assert (1, "alt_name") not in got and (1, "genre") not in got and (2, "genre") not in got
    assert len(got[2, "starring"]) == 5000 and got[2, "starring"][4999] == "Aaa Bbb4999"
    assert got[3, "alt_name"] == ["A B", "A B"]
    assert names(spark, []) == {}


def test_rules():
    assert resolve_skeleton("starring", "w,w&w", {}) == "01010"
    assert resolve_skeleton("genre", "u&u,w", {}) == "00010"
    assert resolve_skeleton("alt_name", "w,u", {}) == "000"
    assert resolve_skeleton("alt_name", "w,u", {"w": 50, "u": 50}) == "010"
    assert resolve_skeleton("alt_name", "w,w", {"w": 3, "w,w": 40}) == "000"
    assert resolve_skeleton("alt_name", "w,h,w,k", {"w": 90, "k": 50, "h,w": 9, "w,u": 9}) == "0100010"
    assert resolve_skeleton("alt_name", "Q,w", {"w": 9}) == "010"
    assert evidence("alt_name", "w,u/k") == ["w,u", "k"] and evidence("alt_name", "w,u") == [] and evidence("alt_name", "w,w,w,w;k") == ["k"]


STRUCTURE = [("starring", "Kim, Soo-hyun; Lee, Min-ho", ["Kim, Soo-hyun", "Lee, Min-ho"]), ("genre", "Sci-fi, action; drama", ["Sci-fi, action", "drama"]),
             ("alt_name", "Oh, My Venus / Omg", ["Oh, My Venus", "Omg"]), ("alt_name", "Hi, My Sweetheart", ["Hi, My Sweetheart"]), ("alt_name", "Goodbye, My Princess | Dong Gong", ["Goodbye, My Princess", "Dong Gong"])]


def test_commas_are_decided_by_structure(spark):
    for f, text, want in STRUCTURE:
        assert names(spark, [(1, *[text if f == x else None for x in FIELDS], "")]) == {(1, f): want}


def test_openers_and_evidence_are_learned(spark):
    rows = [(i, t, None, None, "") for i, t in enumerate(["Ahoy, Red Lamp / 가나", "Ahoy, Blue Door / 다라", "Old Yacht, Frost / 마바", "Rosy Vault, Debt / 사아", "Green Hat; Grey Cat", "New Song, Ahoy, Tall Tree", "Big Dog, Thirst, Tall Tree"])]
    got = names(spark, rows)
    assert got[5, "alt_name"] == ["New Song", "Ahoy, Tall Tree"] and got[6, "alt_name"] == ["Big Dog, Thirst", "Tall Tree"]


def test_rules_decide_rows(spark, monkeypatch):
    rows = [(1, "Ahoy, Red Lamp / 가나", "Kim, Soo-hyun; Lee, Min-ho", None, "")]
    before = names(spark, rows)
    monkeypatch.setattr(packed, "resolve_skeleton", lambda f, s, seen: "".join("1" if c in "N,;|dcsom/" else "0" for c in s))
    assert names(spark, rows) != before
