import itertools
import random

import numpy as np

from lexiloom.llm.language_id import BUCKETS, Chain, features, fit, forward_backward, paragraphs, segments, train

TEXTS = {
    "en": ["the old man walks to the shop with a red bag", "she never said what the letter was about", "they wait at the station until the rain stops", "nobody knows who took the blame for the fire"],
    "es": ["el viejo camina hacia la tienda con una bolsa roja", "ella nunca dijo de qué trataba la carta", "esperan en la estación hasta que deja de llover", "nadie sabe quién cargó con la culpa del fuego"],
    "ko": ["노인은 빨간 가방을 들고 가게로 걸어간다", "그녀는 편지에 대해 말하지 않았다", "그들은 비가 그칠 때까지 역에서 기다린다", "아무도 누가 책임을 졌는지 모른다"],
}


def test_forward_backward_against_enumeration():
    rnd = np.random.default_rng(0)
    s, t = rnd.normal(size=(2, 4, 3)).astype(np.float32), rnd.normal(size=(3, 3))
    m, pairs, log_z = forward_backward(s, np.array([4, 3]), t)
    z, want, both = 0.0, np.zeros((2, 4, 3)), np.zeros((3, 3))
    total = 0.0
    for b, n in ((0, 4), (1, 3)):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.array([np.exp(sum(s[b, i, p[i]] for i in range(n)) + sum(t[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for i in range(n):
                want[b, i, p[i]] += x
            for i in range(n - 1):
                both[p[i], p[i + 1]] += x
        total += np.log(w.sum())
    assert np.allclose(m, want, atol=1e-5) and np.allclose(pairs, both, atol=1e-5)


def test_paragraphs():
    assert paragraphs("a\nb\n\n \n c \r\n\r\nd\n") == ["a\nb", " c ", "d\n"]


def test_segments(spark):
    rows, n = [], 0
    names = {"en": ["EN", "eng", "English"], "es": ["es", "spa", "Spanish"], "ko": ["ko", "kor", "Korean"]}
    for lang, lines in TEXTS.items():
        for k in range(60):
            rows.append((n, "\n\n".join(lines[(k + j) % 4] for j in range(1 + k % 3)), names[lang][k % 3], "clash"))
            n += 1
    extra = [(900, TEXTS["es"][0], "en", "x"), (901, TEXTS["ko"][1], None, "x"), (902, "\n\n".join([TEXTS["en"][0], TEXTS["en"][1], TEXTS["ko"][0], "12345 !!", TEXTS["ko"][2], TEXTS["es"][1]]), "en", "x"), (903, None, "en", "x"), (904, " \n ", None, "x"), (905, "123 ...", "en", "x"), (906, (TEXTS["en"][2] + ". ") * 3000, "und", "x")]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string, seg string")
    model = train(df)
    assert model.labels == ["en", "es", "ko"]
    got = {}
    for r in segments(df, model).collect():
        got.setdefault(r.doc_id, []).append((r.seg, r.lang))
        assert 0 < r.confidence <= 1.000001
    assert [x[1] for x in sorted(got[902])] == ["en", "ko", "es"] and [x[0] for x in sorted(got[902])] == [1, 2, 3]
    assert got[900] == [(1, "es")] and got[901] == [(1, "ko")] and got[906] == [(1, "en")]
    assert not {903, 904, 905} & set(got)
    right = sum(got[i] == [(1, {"E": "en", "e": "en", "s": "es", "S": "es", "k": "ko", "K": "ko"}[r[2][0] if r[2] != "es" else "s"])] for i, r in enumerate(rows))
    assert right >= 0.98 * len(rows)
    assert segments(df, train(df.where("lang is null"))).count() == 0


def test_long_chains_equal_plain_ones():
    rnd = np.random.default_rng(1)
    chain = Chain(list("abcd"), 0.5 * rnd.normal(size=(BUCKETS, 4)).astype(np.float32), rnd.normal(size=(4, 4)))
    for n in (8001, 10_000, 20_123):
        words = [f"w{i}" for i in rnd.integers(0, 300, n)]
        marginal, _, _ = forward_backward(chain.table[chain.rows(words)][None], np.array([n]), chain.transition)
        assert np.allclose(chain.long_mass(words), marginal.sum(1)[0], atol=1e-3) and np.allclose(chain.mass([words, words[:9]])[0], marginal.sum(1)[0], atol=1e-3)


def test_affixes_and_paragraphs_are_whole():
    a, b = "x" * 60 + "abc", "x" * 60 + "xyz"
    assert set(features(a)) - set(features(b)) and len(set(features("y" + a)) & set(features("z" + a))) > len(set(features(a)) & set(features(b)))
    model = fit([["same"] * 500 + ["uno"] * 300, ["same"] * 500 + ["two"] * 300], [0, 1], ["es", "en"])
    assert model.mass([["uno"] * 5])[0].argmax() == 0 and model.mass([["two"] * 5])[0].argmax() == 1


def test_wrong_labels_are_not_learned(spark):
    rnd = random.Random(3)
    stems = {k: [f"{a}{k}{b}" for a in "bdfgklmn" for b in ("o", "ir", "eta", "uns")] for k in ("ar", "el", "is")}
    names = [f"{a}om{b}" for a in "BDGK" for b in "aeio"]
    say = lambda k: " ".join(rnd.choice(stems[k] if rnd.random() < 0.7 else names) for _ in range(40))
    langs = {"ar": "en", "el": "de", "is": "fr"}
    rows, true = [], {}
    for i in range(450):
        k = ("ar", "ar", "el", "is")[i % 4]
        true[i] = langs[k]
        rows.append((i, "\n\n".join(say(k) for _ in range(3)), rnd.choice(["en", "de", "fr"]) if rnd.random() < 0.35 else langs[k]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang for r in segments(df, train(df)).where("n_segments = 1").collect()}
    assert got == true
