import random

import numpy as np

from lexiloom.llm.leaks import WINDOW, _passages, blocks_of, fold, leaks, sharing, stretch


def test_fold():
    assert fold("<p>The <b>Cat</b>&nbsp;sat\u200b, on Mі-ra!</p>") == ["the", "cat", "sat", "on", "mira"]
    assert fold("Ａ１ Café\n가나다 씨") == ["a1", "cafe", "가나다", "씨"]


def test_stretch_against_definition():
    item = [f"w{i}" for i in range(30)]
    assert stretch(["x"] * 5 + item[3:20] + ["y"] * 5, item) == (17, 0)
    changed = item[5:15] + ["zz"] + item[16:27]
    assert stretch(changed, item)[0] == 21 and stretch(changed, item)[1] == 1
    dense = [w if i % 3 else "q" for i, w in enumerate(item)]
    assert stretch(dense, item)[0] < 10
    assert stretch(item[::-1], item)[0] <= 1


def test_windows_cover_every_hit():
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randint(1, 200)
        pos = np.array(sorted(rnd.sample(range(n), min(n, 9))))
        text, start, offset, cols = _passages([pos], [np.arange(len(pos))])
        assert set(cols) == set(range(len(pos)))
        for k in range(len(start)):
            for t in cols[offset[k]:offset[k + 1]]:
                assert start[k] <= pos[t] < start[k] + WINDOW


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "ri", "su", "te", "mo") for b in ("la", "ne", "pi", "zu", "xo", "ga", "hi")]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, say(rnd.randint(24, 60))) for i in range(25)]
    docs = []
    for d in range(120):
        words = say(rnd.randint(30, 120))
        if d % 2:
            _, w = items[d % 25]
            k = len(w) * (2 if d % 4 == 1 else 5) // 5 + 1
            k = k if d % 3 else len(w) // 5
            part = w[2:2 + k]
            if d % 5 == 0:
                part[len(part) // 2] = "changed"
            at = rnd.randint(0, len(words))
            words = words[:at] + part + words[at:]
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else ", ".join(words), "x"))
    docs += [(1001, None, "x"), (1002, "", "x"), (1003, docs[1][1], "x")]
    want = {(d, i) for d, t, _ in docs if t for i, w in items if stretch(fold(t), w)[0] >= len(w) / 3}
    assert len(want) > 30 and (1003, 1) in want
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(df, ev).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in leaks(df, ev, max_terms=200).collect()} == want
    assert leaks(df.limit(0), ev).count() == 0
    assert leaks(df, ev.limit(0)).count() == 0


def test_stretch_takes_matches_after_a_late_edit():
    item = [f"w{i}" for i in range(24)]
    assert stretch(item[:6] + ["zz"] + item[6:8], item) == (8, 1)
    assert stretch(item[:6] + ["zz"] + item[7:13] + ["zz"] + item[13:14], item) == (13, 2)
    assert stretch(item[:5] + ["zz"] + item[5:7], item) == (7, 1)
    assert stretch(item[:3] + ["zz"] + item[3:5], item) == (3, 0)


def test_least_passages_at_every_offset_need_no_cosine(spark):
    rnd = random.Random(5)
    items = [(i, [f"i{i}w{j}" for j in range(n)]) for i, n in enumerate((24, 31, 62, 101))]
    docs, want = [], set()
    for i, words in items:
        need = -(-len(words) // 3)
        for at in range(len(words) - need + 1):
            part = words[at:at + need]
            for edit in (False, True):
                out = [w for j, w in enumerate(part) for w in ([w, "extra"] if edit and j % 6 == 5 and j + 1 < need else [w])]
                pad = [f"x{rnd.randint(0, 999)}" for _ in range(40)]
                k = rnd.randint(0, 40)
                want.add((len(docs), i))
                docs.append((len(docs), " ".join(pad[:k] + out + pad[k:])))
        docs.append((len(docs), " ".join(words[:need - 1])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(df, ev, min_cosine=2.0).collect()} == want


def test_blocks_hold_all_items():
    items = [(i, ["w"] * n) for i, n in enumerate((5, 3, 40, 2, 7, 7))]
    got = blocks_of(items, 10)
    assert [x for b in got for x in b] == items and [[i for i, _ in b] for b in got] == [[0, 1], [2], [3, 4], [5]]


def test_sharing_against_brute_force():
    rnd = random.Random(3)
    rows, passages = ([sorted(rnd.sample(range(12), rnd.randint(1, 4))) for _ in range(n)] for n in (20, 9))
    cols = np.concatenate(passages)
    order = np.argsort(cols, kind="stable")
    of_term = np.searchsorted(cols[order], np.arange(13)), np.repeat(np.arange(9), [len(p) for p in passages])[order]
    for least in (1, 2, 3):
        r, c = sharing(np.cumsum([0, *map(len, rows)]), np.concatenate(rows), of_term, 9, least)
        assert sorted(zip(r.tolist(), c.tolist())) == [(i, j) for i, a in enumerate(rows) for j, b in enumerate(passages) if len(set(a) & set(b)) >= least]


def test_least_passages_of_every_length_with_edits(spark):
    rnd = random.Random(11)
    items = [(n, [f"n{n}w{j}" for j in range(n)]) for n in range(12, 101, 4)]
    docs, want = [], set()
    for n, words in items:
        need = -(-n // 3)
        for kind in range(4):
            at = rnd.randint(0, n - need)
            part = list(words[at:at + need])
            if kind and need >= 6:
                spot = rnd.randint(1, need - 2)
                if kind == 1:
                    part.insert(spot, "added")
                elif kind == 2 and at + need < n:
                    part[spot:spot + 1] = []
                    part.append(words[at + need])
                elif kind == 3 and at + need < n:
                    part[spot] = "changed"
                    part.append(words[at + need])
            if stretch(part, words)[0] * 3 >= n:
                want.add((len(docs), n))
            pad = [f"x{rnd.randint(0, 99)}" for _ in range(30)]
            docs.append((len(docs), " ".join(pad[:15] + part + pad[15:])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert len(want) > 60 and {(r.doc_id, r.item_id) for r in leaks(df, ev).collect()} == want
