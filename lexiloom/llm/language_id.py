"""Languages of documents and of segments in mixed documents by a linear-chain conditional random field.

Each paragraph is a chain of words; states are languages; features are the word itself (lexicon),
affixes, character n-grams and scripts, hashed to a fixed width; transitions are learned. Training
maximises the conditional likelihood on a bounded sample of labelled documents (``SAMPLE`` per
language, chosen by hash, of ``SAMPLE_CHARS`` at most), twice: the first model judges words alone,
without transitions, and paragraphs whose label it contradicts are left out of the second fit. Forward-backward then gives every word of every document
its marginals; a paragraph takes the language with the most mass, neighbours of one language form a
segment, and the mean marginal is the confidence.

Scale: one scan for the sample (the planner cuts each language to ``SAMPLE`` rows before the
shuffle), one scan to label; texts are never shuffled. The model is broadcast; its size is fixed by
``BUCKETS`` x languages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.languages import language_code

SAMPLE, SAMPLE_CHARS = 250, 6000
BUCKETS = 1 << 17
CACHED_WORDS = 300_000
ROUNDS = 40
#: Words of a training chain (longer ones are cut into several), step of the transitions in training.
PIECE, STEP = 400, 0.4
#: Chains of more words go in columns of so many words, COLUMNS at a time.
COLUMN, COLUMNS = 2_000, 64

_WORD = re.compile("[぀-ヿ㐀-䶿一-鿿々]{1,4}|[가-힣ᄀ-ᇿ]+|[^\\W\\d_぀-ヿ㐀-䶿一-鿿가-힣ᄀ-ᇿ々]+(?:['\u2019][^\\W\\d_぀-ヿ㐀-䶿一-鿿가-힣ᄀ-ᇿ々]+)*")
_GAP = re.compile("\n(?:[ \t\f\v ​　]*\n)+")
NO_WORD = -1


def paragraphs(text: str) -> list[str]:
    """Non-blank paragraphs; they are parted by empty lines."""
    return [p for p in _GAP.split(text.replace("\r\n", "\n").replace("\r", "\n")) if p.strip("​﻿ \t\n")]


def words(paragraph: str) -> list[str]:
    """Words in lower case; runs of unspaced scripts are cut to four signs."""
    return _WORD.findall(paragraph.lower())


def _script(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o < 0x3100:
        return "kana"
    if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0:
        return "han"
    if 0xAC00 <= o < 0xD7A4:
        return "hangul"
    return "latin" if o < 0x250 else "other"


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    w = word
    out = {"w=" + word, "s=" + _script(w[0]), "e=" + _script(w[-1])}
    for n in (1, 2, 3):
        if len(w) >= n:
            out.add(f"p{n}={w[:n]}")
    for n in (1, 2, 3, 4):
        if len(w) >= n:
            out.add(f"x{n}={w[-n:]}")
    padded = f"^{w}$"
    out.update("t=" + padded[i:i + 3] for i in range(len(padded) - 2))
    return [zlib.crc32(f.encode()) % BUCKETS for f in out]


class Chain:
    """A linear-chain model: hashed emission weights and transitions over languages."""

    def __init__(self, labels: list[str], emission: np.ndarray, transition: np.ndarray) -> None:
        self.labels, self.emission, self.transition = labels, emission, transition
        self.cache: dict[str, int] = {}
        self.table = np.zeros((1024, len(labels)), np.float32)

    def rows(self, chain: list[str]) -> np.ndarray:
        """Score rows of words; scores are kept per distinct word."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        out = np.empty(len(chain), np.int64)
        for i, w in enumerate(chain):
            r = self.cache.get(w)
            if r is None:
                r = self.cache[w] = len(self.cache)
                if r >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[r] = self.emission[features(w)].sum(0)
            out[i] = r
        return out

    def mass(self, chains: list[list[str]]) -> np.ndarray:
        """Sum of marginals per language of each chain."""
        out = np.zeros((len(chains), len(self.labels)))
        room = 200_000
        for i, c in enumerate(chains):
            if len(c) > COLUMN * 4:
                out[i] = self.long_mass(c)
        order = sorted((i for i in range(len(chains)) if 0 < len(chains[i]) <= COLUMN * 4), key=lambda i: len(chains[i]))
        start = 0
        while start < len(order):
            stop, longest = start, 0
            while stop < len(order) and (stop == start or (stop - start + 1) * len(chains[order[stop]]) <= room):
                longest = len(chains[order[stop]])
                stop += 1
            group = order[start:stop]
            scores = np.zeros((len(group), longest, len(self.labels)), np.float32)
            sizes = np.array([len(chains[i]) for i in group])
            for k, i in enumerate(group):
                rows = self.rows(chains[i])
                scores[k, :len(rows)] = self.table[rows]
            marginal, _, _ = forward_backward(scores, sizes, self.transition, with_pairs=False)
            out[group] = marginal.sum(1)
            start = stop
        return out


    def long_mass(self, chain: list[str]) -> np.ndarray:
        """Sum of marginals per language of one long chain, in columns with carried forward and backward states.

        The transfer matrix of each column gives the states at all borders; then columns are run side by
        side, so the work is linear and only one row of scores a word grows with the chain.
        """
        n, k, t = len(chain), len(self.labels), np.exp(self.transition)
        count = -(-n // COLUMN)
        score = np.empty((n, k), np.float32)
        for a in range(0, n, CACHED_WORDS // 2):
            part = chain[a:a + CACHED_WORDS // 2]
            score[a:a + len(part)] = self.table[self.rows(part)]

        def columns(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            x = np.zeros(((hi - lo) * COLUMN, k))
            live = np.zeros(len(x), bool)
            part = score[lo * COLUMN:min(n, hi * COLUMN)]
            x[:len(part)], live[:len(part)] = np.exp(part - part.max(1, keepdims=True)), True
            return x.reshape(hi - lo, COLUMN, k), live.reshape(hi - lo, COLUMN)

        transfer = np.empty((count, k, k))
        for lo in range(0, count, COLUMNS):
            e, live = columns(lo, min(lo + COLUMNS, count))
            p = np.broadcast_to(np.eye(k), (len(e), k, k)).copy()
            for i in range(COLUMN):
                q = p @ t
                if lo == 0 and i == 0:
                    q[0] = p[0]
                q = q * e[:, i, None, :]
                q /= np.maximum(q.sum((1, 2), keepdims=True), 1e-300)
                p = np.where(live[:, i, None, None], q, p)
            transfer[lo:lo + len(e)] = p
        before, behind = np.empty((count, k)), np.empty((count, k))
        state = np.full(k, 1 / k)
        for c in range(count):
            before[c] = state
            state = state @ transfer[c]
            state /= state.sum()
        state = np.ones(k)
        for c in range(count - 1, -1, -1):
            behind[c] = state
            state = transfer[c] @ state
            state /= state.sum()
        out = np.zeros(k)
        for lo in range(0, count, COLUMNS):
            hi = min(lo + COLUMNS, count)
            e, live = columns(lo, hi)
            alpha = np.empty((COLUMN, hi - lo, k))
            a = before[lo:hi]
            for i in range(COLUMN):
                q = a @ t
                if lo == 0 and i == 0:
                    q[0] = a[0]
                q = q * e[:, i]
                q /= np.maximum(q.sum(1, keepdims=True), 1e-300)
                a = alpha[i] = np.where(live[:, i, None], q, a)
            b = behind[lo:hi]
            for i in range(COLUMN - 1, -1, -1):
                g = alpha[i] * b
                out += ((g / g.sum(1, keepdims=True)) * live[:, i, None]).sum(0)
                q = (e[:, i] * b) @ t.T
                b = np.where(live[:, i, None], q / np.maximum(q.sum(1, keepdims=True), 1e-300), b)
        return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transition: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (zero behind a chain's end), expected transitions and the log normaliser of padded chains."""
    b, n, k = scores.shape
    top = scores.max(2, keepdims=True)
    e = np.exp((scores - top).astype(np.float64))
    t = np.exp(transition)
    live = np.arange(n)[None, :] < sizes[:, None]
    alpha, scale = np.empty((n, b, k)), np.ones((n, b))
    a = e[:, 0] / k
    for i in range(n):
        if i:
            a = np.where(live[:, i, None], (alpha[i - 1] @ t) * e[:, i], alpha[i - 1])
        c = np.where(live[:, i], a.sum(1), 1.0)
        alpha[i], scale[i] = a / c[:, None], c
    marginal, pairs = np.empty((n, b, k)), np.zeros((k, k))
    beta = np.ones((b, k))
    for i in range(n - 1, -1, -1):
        g = alpha[i] * beta
        marginal[i] = g / g.sum(1, keepdims=True) * live[:, i, None]
        if i:
            back = e[:, i] * beta / scale[i][:, None]
            on = live[:, i, None]
            if with_pairs:
                pairs += t * (np.where(on, alpha[i - 1], 0).T @ np.where(on, back, 0))
            beta = np.where(on, back @ t.T, beta)
    log_z = float(np.log(scale).sum() + (top[:, :, 0] * live).sum())
    return marginal.transpose(1, 0, 2), pairs, log_z


def fit(chains: list[list[str]], targets: list[int], labels: list[str], rounds: int = ROUNDS, l2: float = 1e-4, step: float = STEP) -> Chain:
    """Full-batch adaptive gradient ascent on the conditional likelihood; every word of a chain bears its document's label."""
    vocab: dict[str, int] = {}
    pieces = [(c[a:a + PIECE], t) for c, t in zip(chains, targets) for a in range(0, len(c), PIECE)]
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in c]) for c, _ in pieces]
    target = np.array([t for _, t in pieces])
    k, v = len(labels), len(vocab)
    feats = [features(w) for w in vocab]
    owner = np.repeat(np.arange(v), [len(f) for f in feats])
    flat = np.array([x for f in feats for x in f])
    emission, transition = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    ge, gt = np.full((BUCKETS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    order = np.argsort([len(i) for i in ids])
    groups = [order[i:i + 1024] for i in range(0, len(order), 1024)]
    weight = 1.0 / max(1, sum(map(len, ids)))
    seen = np.stack([np.bincount(np.concatenate([i for i, t in zip(ids, target) if t == j] or [np.array([], np.int64)]), minlength=v) for j in range(k)], 1)
    for _ in range(rounds):
        table = np.stack([np.bincount(owner, emission[flat, j], v) for j in range(k)], 1)
        g_word, g_pairs = np.zeros((v, k)), np.zeros((k, k))
        if not step:  # without transitions a word's marginals are its own
            e = np.exp(table - table.max(1, keepdims=True))
            g_word = seen - seen.sum(1, keepdims=True) * e / e.sum(1, keepdims=True)
        for group in groups if step else ():
            sizes = np.array([len(ids[i]) for i in group])
            words_ = np.zeros((len(group), sizes.max()), np.int64)
            live = np.arange(sizes.max())[None, :] < sizes[:, None]
            for r, i in enumerate(group):
                words_[r, :len(ids[i])] = ids[i]
            marginal, pairs, _ = forward_backward(table[words_].astype(np.float32), sizes, transition)
            gold = np.eye(k)[target[group]][:, None, :] * live[:, :, None]
            diff = (gold - marginal)[live]
            for j in range(k):
                g_word[:, j] += np.bincount(words_[live], diff[:, j], v)
            np.fill_diagonal(g_pairs, g_pairs.diagonal() + np.bincount(target[group], sizes - 1, k))
            g_pairs -= pairs
        grad = np.stack([np.bincount(flat, g_word[owner, j], BUCKETS) for j in range(k)], 1) * weight - l2 * emission * weight * 100
        ge += grad ** 2
        emission += (0.3 * grad / np.sqrt(ge)).astype(np.float32)
        gp = g_pairs * weight
        gt += gp ** 2
        transition += step * gp / np.sqrt(gt)
        transition = np.clip(transition, -6, 6)
    return Chain(labels, emission, transition)


def train(df: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Chain | None:
    """Fit on documents (doc_id, text, lang) with a readable label; none if no document has one."""
    labelled = df.select("text", language_code(F.col("lang")).alias("label"), F.xxhash64("doc_id").alias("h")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= sample_chars))
    w = Window.partitionBy("label").orderBy("h", "text")
    rows = labelled.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).select("label", "text").orderBy("label", "text").collect()
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return None
    place = {x: i for i, x in enumerate(labels)}
    docs = [([words(p) for p in paragraphs(r["text"])], place[r["label"]]) for r in rows]
    chains, targets = [c for d, _ in docs for c in d], [t for d, t in docs for _ in d]
    # without transitions each word speaks for itself: they would carry a wrong label over its whole chain and learn it
    first = fit(chains, targets, labels, ROUNDS // 2, step=0.0)
    mass = first.mass(chains)
    agree = [i for i in range(len(chains)) if chains[i] and mass[i].argmax() == targets[i]]
    return fit([chains[i] for i in agree], [targets[i] for i in agree], labels)


def _segments(model: Chain, texts: list[str | None]) -> list[list[tuple[int, str, float]]]:
    """(segment, language, confidence) of each text."""
    parts = [paragraphs(t) if t else [] for t in texts]
    chains = [words(p) for d in parts for p in d]
    mass = model.mass(chains)
    out, at = [], 0
    for d in parts:
        runs: list[list] = []
        for m in mass[at:at + len(d)]:
            if m.sum() <= 0:
                continue
            lang = int(m.argmax())
            if runs and runs[-1][0] == lang:
                runs[-1][1] += m
            else:
                runs.append([lang, m.copy()])
        at += len(d)
        out.append([(i + 1, model.labels[lang], float(m[lang] / m.sum())) for i, (lang, m) in enumerate(runs)])
    return out


def segments(df: DataFrame, model: Chain | None) -> DataFrame:
    """Rows (doc_id, label, seg, lang, confidence, n_segments) of documents (doc_id, text, lang).

    Null and blank texts and texts without a letter give no row; repeated rows give repeated rows;
    ``label`` is the two-letter code of the given label, null where it says nothing.
    """
    rows = df.select("doc_id", language_code(F.col("lang")).alias("label"), "text").where(F.col("text").rlike(r"\p{L}"))
    schema = "doc_id bigint, label string, seg int, lang string, confidence double, n_segments int"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast((model.labels, model.emission.astype(np.float16), model.transition))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, emission, transition = shared.value
        chain = Chain(labels, emission.astype(np.float32), transition)
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                pdf = whole.iloc[lo:lo + 2000]
                found = _segments(chain, pdf["text"].tolist())
                yield pd.DataFrame([(d, x, i, lang, c, len(f)) for d, x, f in zip(pdf["doc_id"], pdf["label"], found) for i, lang, c in f],
                                   columns=["doc_id", "label", "seg", "lang", "confidence", "n_segments"])

    return rows.mapInPandas(run, schema)
