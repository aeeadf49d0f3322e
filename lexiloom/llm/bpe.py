"""Exact byte-level BPE by per-prefix dynamic programming.

For every prefix of a piece there is one last token that BPE's own result for that prefix ends in.
An automaton with suffix links lists the tokens that end at a position; the pair test decides
whether a token may follow the last token of the prefix before it, by undoing merges on both sides
of the border and looking for an earlier merge across it. Back-pointers then give the ids. The cost
is linear in the piece, however long it is. Pieces repeat, so their ids are kept in a bounded
per-worker cache.

The vocabulary file is read once on the driver and broadcast (its size, a few MB, is bounded by the
tokenizer, not by data; ``MAX_VOCABULARY_BYTES`` is enforced). Texts are encoded where they are
read: no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MAX_VOCABULARY_BYTES = 64 << 20
CACHED_PIECES, CACHED_LENGTH = 500_000, 64
_SPACE = r"\t-\r \u0085   -     　"
#: The published pattern that parts a text into pieces, with white space spelled out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder over the pieces of a byte-level BPE vocabulary whose ids above the single bytes follow merge order."""

    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.size: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        merged = set()
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            if ab not in self.split:
                self.split[ab], self.rank[ab] = (a, b), rank
                merged.add(ab)
            self.pair[a, b] = ab
        for text, i in vocab.items():
            if i in merged or len(text) == 1:
                raw = bytes(letters[c] for c in text)
                self.size[i] = len(raw)
                self.split.setdefault(i, (i, i))
                self.rank.setdefault(i, -1)
                self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.follows = lru_cache(maxsize=1_000_000)(self._follows)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens a and b alone."""
        rank, split, pair = self.rank, self.split, self.pair
        # Merges across the border count only if they come before the ones undone so far; of equal
        # rank the left one comes first.
        limit, left_first = float("inf"), False
        while True:
            across = pair.get((a, b))
            if across is not None and (rank[across] < limit or rank[across] == limit and left_first):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, left_first, a = ra, False, split[a][1]
            else:
                limit, left_first, b = rb, True, split[b][0]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        last = [-1] * (n + 1)
        size, follows = self.size, self.follows
        for end, token in self.automaton.iter(raw):
            stop = end + 1
            if last[stop] >= 0:
                continue
            start = stop - size[token]
            if start == 0 or last[start] >= 0 and follows(last[start], token):
                last[stop] = token
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return tuple(reversed(out))

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        out: list[int] = []
        cache = self.cache
        for m in PIECES.findall(text):
            got = cache.get(m)
            if got is None:
                got = self.piece(m)
                if len(m) <= CACHED_LENGTH and len(cache) < CACHED_PIECES:
                    cache[m] = got
            out += got
        return out

    def count(self, text: str) -> int:
        """Number of ids of a whole text."""
        return len(self.ids(text))


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> PrefixEncoder:
    return PrefixEncoder(vocabulary)


def read_vocabulary(path: str = DEFAULT_TOKENIZER) -> bytes:
    """The vocabulary file, refused if it is larger than any tokenizer's should be."""
    raw = Path(path).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    return raw


def _run(vocabulary, batches: Iterable[pa.RecordBatch], make: Callable[[PrefixEncoder, list], list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(vocabulary.value)
    for batch in batches:
        keys, texts = batch.columns[:-1], batch.columns[-1]
        yield pa.RecordBatch.from_arrays([*keys, *make(encoder, texts)], names=names)


def _id_lists(encoder: PrefixEncoder, texts: pa.Array) -> list[pa.Array]:
    from array import array

    flat, offsets = array("i"), array("i", [0])
    for t in texts:
        s = t.as_py()
        if s:
            flat.extend(encoder.ids(s))
        offsets.append(len(flat))
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Rows (key, ids): ids of each text without special tokens; null and empty texts give an empty list.

    Repeated rows stay; texts that name special tokens are ordinary text; columns besides ``key`` and
    ``text`` are not read.
    """
    spark: SparkSession = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    return df.select(key, text).mapInArrow(lambda it: _run(vocabulary, it, _id_lists, [key, "ids"]), f"`{key}` bigint, ids array<int>")
