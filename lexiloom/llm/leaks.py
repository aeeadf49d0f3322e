"""Evaluation passages in training texts, found by latent semantic retrieval and checked by alignment.

1. Texts are folded (case, punctuation, markup, invisible signs, look-alike letters) into words. Terms
   are word pairs of the evaluation items; which of them a document holds, and where, is kept.
2. Passages are windows of ``WINDOW`` words. Document frequencies of terms over all windows of all
   documents give TF-IDF weights.
3. A distributed randomised SVD (random test matrix, one power step) of the passages of both sides
   spans the latent space; each pass multiplies the rows where they are and adds up term blocks.
4. Every window whose cosine with an item passage reaches ``MIN_COSINE`` in the latent space is a
   candidate; there is no cap on candidates. The latent space keeps little of some windows, so every
   place with as many word pairs of an item as the alignment implies (``bounds``) is a candidate too,
   whatever its cosine: no passage that step 5 would accept is lost before it.
5. A word alignment of candidate and item decides: matched words at least a third of the item's, at
   most one word in seven changed, left out or added.

Scale: broadcast are only the items' terms and the latent basis of one block of items; both are bounded
by ``MAX_TERMS``, larger evaluation sets go in several blocks. Sums of the decomposition come from as
many tasks as the cluster has cores. Windows meet item passages over shared terms. Documents shrink to their term hits in the first scan, which are
written to the checkpoint folder; texts are never shuffled. Hot sources don't matter: nothing is
grouped by source.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.runtime import cut

WINDOW, STRIDE = 24, 8
RANK, OVERSAMPLE, SEED = 256, 16, 20240
MIN_COSINE = 0.55
SHARE, EDITS = 1 / 3, 7
MAX_TERMS = 50_000

#: Letters of other scripts that look like Latin letters, and the letters they look like.
LOOK_ALIKES = str.maketrans(dict(zip(
    "аеорсухіјѕһԁԛԝӏқғңүвкмнтгпьѵαβγεζηικνορτυχϲϳ",
    "aeopcyxijshdqwlkfhybkmhtrnbvabyezniknoptuxcj", strict=True)) | {"ı": "i", "ł": "l", "đ": "d", "ø": "o", "ꞵ": "b", "ɡ": "g", "ɑ": "a", "օ": "o", "ո": "n", "ս": "u", "հ": "h"})
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\{\{|\}\}|\]\([^()\s]*\)|\\[a-z]+(?=\{)", re.S)
_SIGNS = re.compile(r"[^\w\s]|_")


def fold(text: str) -> list[str]:
    """Words of a text as a reader hears them."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    t = _MARKUP.sub(lambda m: "" if m.group()[0] in "<" and m.group()[1:2] != "p" else " ", t).casefold()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)).translate(LOOK_ALIKES)
        t = unicodedata.normalize("NFC", t)
    return _SIGNS.sub("", t.replace("—", " ").replace("–", " ").replace("/", " ").replace("…", " ")).split()


def windows(n: int) -> range:
    """Starts of the windows over n words."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def bounds(n_words: int, share: float = SHARE) -> tuple[int, int]:
    """(pairs, reach) of an item of n words: every accepted stretch holds a part of at most ``reach`` words with ``pairs`` word pairs of the item.

    Of an accepted stretch with twice the needed words, the first or the second half is accepted alone, so one
    with k matched words, need <= k < 2 need, exists; its e <= k / (EDITS - 1) edits leave k - 1 - e pairs.
    """
    need = max(1, math.ceil(n_words * share - 1e-9))
    most = min(n_words, 2 * need - 1)
    return max(1, need - 1 - need // (EDITS - 1)), most + most // (EDITS - 1)


def item_terms(items: list[tuple[int, list[str]]]) -> dict[tuple[str, str], int]:
    """Number of each word pair of the items."""
    terms: dict[tuple[str, str], int] = {}
    for _, words in items:
        for pair in zip(words, words[1:]):
            terms.setdefault(pair, len(terms))
    return terms


def blocks_of(items: list[tuple[int, list[str]]], most: int = MAX_TERMS) -> list[list[tuple[int, list[str]]]]:
    """The items in blocks of at most ``most`` word pairs; an item with more is a block of its own."""
    out: list[list[tuple[int, list[str]]]] = []
    room = 0
    for item in items:
        size = len(item[1]) - 1
        if size > room or not out:
            out.append([])
            room = most
        out[-1].append(item)
        room -= size
    return out


def hits(df: DataFrame, terms) -> DataFrame:
    """(doc_id, n_words, pos, term): where a document holds terms; one row for each document, nulls and blanks included."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = terms.value.get
        for pdf in batches:
            out = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                words = fold(text) if text else []
                pos, term = [], []
                for i, pair in enumerate(zip(words, words[1:])):
                    t = get(pair)
                    if t is not None:
                        pos.append(i)
                        term.append(t)
                out.append((key, len(words), pos, term))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "pos", "term"])

    return df.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_words int, pos array<int>, term array<int>")


def _passages(pos: Iterable[np.ndarray], term: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all windows with terms: (text, start, row offsets, terms), each term once per window."""
    pos, term = ([np.asarray(x, np.int64) for x in xs] for xs in (pos, term))
    owner = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
    if not len(owner):
        return owner, owner, np.zeros(1, np.int64), owner
    p, t = np.concatenate(pos), np.concatenate(term)
    most, n_terms = p.max() // STRIDE + 1, t.max() + 1
    keys = []
    for back in range(-(-(WINDOW - 1) // STRIDE)):
        a = p // STRIDE - back
        ok = (a >= 0) & (p - a * STRIDE < WINDOW - 1)
        keys.append(((owner[ok] * most + a[ok]) * n_terms) + t[ok])
    key = np.unique(np.concatenate(keys))
    window, cols = key // n_terms, key % n_terms
    first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    return window[first] // most, window[first] % most * STRIDE, np.r_[first, len(cols)], cols


def _rows(offset: np.ndarray, cols: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length, aligned with cols."""
    v = idf[cols]
    norm = np.sqrt(np.add.reduceat(v * v, offset[:-1])) if len(cols) else np.array([])
    return v / np.repeat(norm, np.diff(offset))


def _times(offset: np.ndarray, cols: np.ndarray, vals: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix, in blocks."""
    out = np.empty((len(offset) - 1, m.shape[1]), np.float32)
    step = 2048
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        lo, hi = offset[a], offset[b]
        out[a:b] = np.add.reduceat(m[cols[lo:hi]] * vals[lo:hi, None], offset[a:b] - lo, axis=0)
    return out


def _transposed(offset: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_terms: int) -> dict[int, np.ndarray]:
    """The transposed sparse rows times y, for the terms that occur."""
    order = np.argsort(cols, kind="stable")
    rows = np.repeat(np.arange(len(offset) - 1), np.diff(offset))[order]
    c, v = cols[order], vals[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    out = {}
    for a, b in zip(first, np.r_[first[1:], len(c)]):
        out[int(c[a])] = v[a:b] @ y[rows[a:b]]
    return out


def _gram_times(found: DataFrame, idf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A'A m of the documents' passages: products where the rows are, sums by term."""
    shared = found.sparkSession.sparkContext.broadcast((idf, m.astype(np.float32)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, x = shared.value
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            _, _, offset, cols = _passages(pdf["pos"], pdf["term"])
            if not len(cols):
                continue
            vals = _rows(offset, cols, w).astype(np.float32)
            for t, z in _transposed(offset, cols, vals, _times(offset, cols, vals, x), len(w)).items():
                total[t] = total[t] + z if t in total else z
        yield pd.DataFrame({"term": pd.Series(list(total), dtype="int32"), "z": [z.astype(np.float32) for z in total.values()]})

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for t, z in zip(pdf["term"], pdf["z"]):
                total[t] = total[t] + z if t in total else np.asarray(z, np.float64)
        yield pd.DataFrame({"term": pd.Series(list(total), dtype="int32"), "z": pd.Series(list(total.values()), dtype=object)})

    # every task gives up to one row a term: as many tasks as cores, not as input files
    parts = found.where("size(pos) > 0").coalesce(found.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "term int, z array<float>")
    out = np.zeros(m.shape)
    for r in parts.repartition("term").mapInPandas(add, "term int, z array<double>").toPandas().itertuples():
        out[r.term] = r.z
    return out


def latent_basis(found: DataFrame, items: tuple, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular basis (terms x rank) of the passages of both sides; the items' rows are scaled to the same total energy as the documents'."""
    _, offset, cols = items
    vals = _rows(offset, cols, idf)
    width = min(rank + OVERSAMPLE, len(idf))
    m = np.random.default_rng(SEED).standard_normal((len(idf), width))
    n_rows = max(1, found.agg(F.sum(F.size("pos"))).first()[0] or 0)
    scale = max(1.0, n_rows / max(1, len(cols)))

    def gram(x: np.ndarray) -> np.ndarray:
        z = _gram_times(found, idf, x)
        for t, row in _transposed(offset, cols, vals, _times(offset, cols, vals, x.astype(np.float32)), len(idf)).items():
            z[t] += scale * row
        return z

    q, _ = np.linalg.qr(gram(m))
    z = gram(q)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return (q @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def held_pairs(items: list[tuple[int, list[str]]], terms: dict[tuple[str, str], int], share: float = SHARE) -> tuple[np.ndarray, ...]:
    """(offset of each term, numbers of the items that hold it, item ids, pairs, reach): what ``bounded`` looks up."""
    held = sorted({(terms[p], k) for k, (_, w) in enumerate(items) for p in zip(w, w[1:])})
    offset = np.zeros(len(terms) + 1, np.int64)
    np.add.at(offset, np.array([t for t, _ in held]) + 1, 1)
    limits = np.array([bounds(len(w), share) for _, w in items])
    return np.cumsum(offset), np.array([k for _, k in held]), np.array([i for i, _ in items]), limits[:, 0], limits[:, 1]


def bounded(pos: list[np.ndarray], term: list[np.ndarray], held: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item id, start): places from which a text holds enough word pairs of an item within the item's reach."""
    offset, numbers, ids, pairs, reach = held
    text = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
    p, t = (np.concatenate([np.asarray(x, np.int64) for x in xs]) if len(xs) else np.array([], np.int64) for xs in (pos, term))
    size = offset[t + 1] - offset[t]
    row = np.repeat(np.arange(len(t)), size)
    item = numbers[np.repeat(offset[t] - np.cumsum(size) + size, size) + np.arange(len(row))]
    key = text[row] * len(ids) + item
    order = np.lexsort((p[row], key))
    key, at, item = key[order], p[row][order], item[order]
    i = np.arange(len(key))
    j = i + pairs[item] - 1
    i, j = i[j < len(key)], j[j < len(key)]
    ok = (key[j] == key[i]) & (at[j] - at[i] + 2 <= reach[item[i]])
    i = i[ok]
    return key[i] // len(ids), ids[item[i]], at[i]


def sharing(offset: np.ndarray, cols: np.ndarray, of_term: tuple[np.ndarray, np.ndarray], n_passages: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(row, passage): the item passages that share ``least`` terms with each sparse row, each once."""
    first, passages = of_term
    size = first[cols + 1] - first[cols]
    row = np.repeat(np.repeat(np.arange(len(offset) - 1), np.diff(offset)), size)
    at = passages[np.repeat(first[cols] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    key = np.sort(row * n_passages + at)
    # each term stands once in a row and in a passage: equal keys are shared terms
    key = key[:len(key) - least + 1][key[:len(key) - least + 1] == key[least - 1:]] if least > 1 else key
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key // n_passages, key % n_passages


def candidates(found: DataFrame, items: tuple, idf: np.ndarray, basis: np.ndarray, held: tuple[np.ndarray, ...], min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, item_id, starts): windows whose latent cosine with a passage of the item reaches min_cosine, and places with the word pairs that an accepted stretch must have.

    A window meets the passages that share two terms with it, over an index from terms to passages, and
    isn't multiplied with all of them; what one shared term can pass the check for, ``bounded`` finds.
    """
    owner, offset, cols = items
    vals = _rows(offset, cols, idf)
    latent = _times(offset, cols, vals, basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    order = np.argsort(cols, kind="stable")
    of_term = np.searchsorted(cols[order], np.arange(len(idf) + 1)), np.repeat(np.arange(len(offset) - 1), np.diff(offset))[order]
    shared = found.sparkSession.sparkContext.broadcast((owner, latent, basis, idf, held, of_term))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, latent, basis, idf, held, of_term = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 500):
                pdf = whole.iloc[lo:lo + 500]
                text, start, offset, cols = _passages(pdf["pos"], pdf["term"])
                pairs: dict[tuple[int, int], set[int]] = {}
                if len(cols):
                    keys = pdf["doc_id"].to_numpy()
                    y = _times(offset, cols, _rows(offset, cols, idf), basis)
                    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
                    r, c = sharing(offset, cols, of_term, len(latent))
                    for a in range(0, len(r), 65_536):
                        i, j = r[a:a + 65_536], c[a:a + 65_536]
                        near = np.einsum("ij,ij->i", y[i], latent[j]) >= min_cosine
                        for w, item in zip(i[near], owner[j[near]]):
                            pairs.setdefault((int(keys[text[w]]), int(item)), set()).add(int(start[w]))
                    for i, j, s in zip(*bounded(pdf["pos"].tolist(), pdf["term"].tolist(), held)):
                        pairs.setdefault((int(keys[i]), int(j)), set()).add(int(s))
                yield pd.DataFrame([(d, i, sorted(s)) for (d, i), s in pairs.items()], columns=["doc_id", "item_id", "starts"])

    return found.where("size(pos) > 0").mapInPandas(run, "doc_id bigint, item_id bigint, starts array<int>")


def stretch(words: list[str], item: list[str]) -> tuple[int, int]:
    """(matched words, edits) of the best stretch: most matched words with at most one edit in seven words.

    For each number of edits the most matched words of any stretch, by dynamic programming along the
    anti-diagonals: one score for all edits would take the best scored stretch, not the longest allowed one.
    """
    n, m = len(words), len(item)
    levels = m // (EDITS - 1)
    place = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.full(n + 2 * m, -1)
    a[m:m + n] = [place.get(w, -1) for w in words]
    b = np.array([place[w] for w in item])
    one = two = best = np.zeros((levels + 1, m + 1), np.int16)
    for d in range(2, n + m + 1):
        cur = np.zeros_like(best)
        cur[:, 1:] = (two[:, :-1] + 1) * (a[d - 1:d - 1 + m][::-1] == b)
        for before in (one[:-1, 1:], one[:-1, :-1], two[:-1, :-1]):
            np.maximum(cur[1:, 1:], before, out=cur[1:, 1:])
        best = np.maximum(best, cur)
        one, two = cur, one
    matched = best.max(axis=1)
    matched = np.where(matched >= (EDITS - 1) * np.arange(levels + 1), matched, 0)
    edits = int(matched.argmax())
    return int(matched[edits]), edits


def verify(df: DataFrame, pairs: DataFrame, items: list[tuple[int, list[str]]], share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, edits, words) of the candidates that carry enough of the item."""
    shared = df.sparkSession.sparkContext.broadcast({i: (w, set(zip(w, w[1:]))) for i, w in items})
    grouped = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "starts")).alias("found"))
    texts = df.select("doc_id", "text").join(grouped, "doc_id")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for pdf in batches:
            out = []
            for key, text, found in zip(pdf["doc_id"], pdf["text"], pdf["found"]):
                words = fold(text)
                for f in found:
                    (item, held), starts = of[f["item_id"]], list(f["starts"])
                    need, (least, within) = len(item) * share, bounds(len(item), share)
                    reach = max(len(item), within)
                    best = (0, 0)
                    at = 0
                    while at < len(starts):
                        end = at
                        while end + 1 < len(starts) and starts[end + 1] <= starts[end] + WINDOW + reach:
                            end += 1
                        part = words[max(0, starts[at] - reach):starts[end] + WINDOW + reach]
                        at = end + 1
                        # only a part with as many of the item's pairs, as close, as an accepted stretch must have is aligned
                        hit = [i for i, p in enumerate(zip(part, part[1:])) if p in held]
                        if any(b - a + 2 <= within for a, b in zip(hit, hit[least - 1:])):
                            best = max(best, stretch(part, item))
                    if best[0] >= need - 1e-9:
                        out.append((key, f["item_id"], best[0], best[1], len(item)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "edits", "words"])

    return texts.mapInPandas(run, "doc_id bigint, item_id bigint, matched int, edits int, words int")


def leaks(documents: DataFrame, eval_items: DataFrame, share: float = SHARE, min_cosine: float = MIN_COSINE, max_terms: int = MAX_TERMS) -> DataFrame:
    """Rows (doc_id, item_id, matched, edits, words): which documents (doc_id, text) carry which items (item_id, text).

    Null and blank documents and items give no row; repeated documents are found each; items of equal
    text are found each. Items are collected: they are the bounded side. Sets of more than ``max_terms``
    word pairs go in blocks, each with a scan of its own.
    """
    spark = documents.sparkSession
    items = sorted({(r["item_id"], tuple(fold(r["text"]))) for r in eval_items.select("item_id", "text").where("text is not null and item_id is not null").collect()})
    items = [(i, list(w)) for i, w in items if len(w) > 1]
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, matched int, edits int, words int")
    for block in blocks_of(items, max_terms):
        out = out.unionByName(_leaks_of(documents, block, share, min_cosine))
    return out


def _leaks_of(documents: DataFrame, items: list[tuple[int, list[str]]], share: float, min_cosine: float) -> DataFrame:
    """The leaks of one block of items."""
    spark = documents.sparkSession
    terms = item_terms(items)
    found = cut(hits(documents.where("text is not null"), spark.sparkContext.broadcast(terms)))
    spans = F.floor((F.greatest("n_words", F.lit(WINDOW)) - WINDOW) / STRIDE) + 1
    # a term at word p lies in the windows that start from p - WINDOW + 2 to p: as many for every term
    n = found.agg(F.sum(spans)).first()[0] or 1
    df = np.ones(len(terms))
    for r in found.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").count().collect():
        df[r["term"]] += r["count"]
    idf = np.log(1 + max(n, 1) / df).astype(np.float32)
    text, start, offset, cols = _passages([np.arange(len(w) - 1) for _, w in items], [np.array([terms[p] for p in zip(w, w[1:])]) for _, w in items])
    side = np.array([i for i, _ in items])[text], offset, cols
    basis = latent_basis(found, side, idf)
    return verify(documents, candidates(found, side, idf, basis, held_pairs(items, terms, share), min_cosine), items, share)
