"""Tokens per document and totals per site, language and source.

Per document two counts come out: ``tokens``, exact under the tokenizer, and ``longest_match``, the
linear count of greedy longest matches over the same vocabulary by a trie with failure links and
stored emissions. The public vocabularies here are merge-based, for which longest match is an
estimate only; the exact count comes from the prefix encoder. For a longest-match vocabulary
``MaxMatchTrie`` alone is exact.

Only counts and short labels are shuffled, never texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.domains import site_key
from lexiloom.llm.bpe import CACHED_LENGTH, CACHED_PIECES, DEFAULT_TOKENIZER, PIECES, PrefixEncoder, _run, byte_letters, read_vocabulary
from lexiloom.llm.languages import language_code
from lexiloom.llm.maxmatch import MaxMatchTrie

UNKNOWN = "unknown"


@lru_cache(maxsize=1)
def _trie(vocabulary: bytes) -> tuple[MaxMatchTrie, dict[int, str], dict[str, tuple[int, int]]]:
    return MaxMatchTrie(json.loads(vocabulary)["model"]["vocab"]), {b: c for c, b in byte_letters().items()}, {}


def token_counts(df: DataFrame, key: str, text: str, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Rows (key, tokens, longest_match) of each text; null and empty texts have 0. Other columns stay before them."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    keep = [c for c in df.columns if c != text]
    names = [*keep, "tokens", "longest_match"]

    def both(encoder: PrefixEncoder, texts: pa.Array) -> list[pa.Array]:
        trie, letters, cache = _trie(vocabulary.value)
        exact, greedy = [], []
        for t in texts:
            a = b = 0
            for piece in PIECES.findall(t.as_py() or ""):
                got = cache.get(piece)
                if got is None:
                    word = "".join(map(letters.__getitem__, piece.encode("utf-8", "surrogatepass")))
                    got = len(encoder.piece(piece)), trie.count(word) or 0
                    if len(piece) <= CACHED_LENGTH and len(cache) < CACHED_PIECES:
                        cache[piece] = got
                a += got[0]
                b += got[1]
            exact.append(a)
            greedy.append(b)
        return [pa.array(exact, pa.int64()), pa.array(greedy, pa.int64())]

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "tokens bigint", "longest_match bigint"])
    return df.select(*keep, text).mapInArrow(lambda it: _run(vocabulary, it, both, names), schema)


def document_tokens(documents: DataFrame, docs: DataFrame, sites: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """One row per document: doc_id, site, lang, source, words, tokens, longest_match.

    Index rows of one document fold into one: its site is the one most rows agree on after folding
    spellings (ties: first in order), its words the largest length that isn't negative. A document
    without an index row has site ``unknown``. Documents of the same text count each; repeated rows of
    a doc_id count once.
    """
    texts = documents.select("doc_id", F.coalesce(language_code(F.col("lang")), F.lit(UNKNOWN)).alias("lang"), site_key(F.col("source")).alias("source"), "text")
    counted = token_counts(texts, "doc_id", "text", path)
    counted = counted.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("lang", "source", "tokens", "longest_match")])
    named = docs.select("doc_id", F.coalesce(site_key(F.col("site")), site_key(F.split_part("path", F.lit("/"), F.lit(1)))).alias("site"), F.when(F.col("length") >= 0, F.col("length")).alias("length")).where("doc_id is not null")
    votes = named.groupBy("doc_id", "site").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    index = votes.groupBy("doc_id").agg(F.max_by("site", F.struct(F.col("site").isNotNull(), "n", "site")).alias("site"), F.max("length").alias("words"))
    names = sites.select(site_key(F.col("domain")).alias("k"), F.lower("domain").alias("domain")).dropDuplicates(["k"])
    out = counted.join(index, "doc_id", "left")
    for c in ("site", "source"):
        out = out.join(names.withColumnsRenamed({"k": c, "domain": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c, F.lit(UNKNOWN))).drop(f"_{c}")
    return out.select("doc_id", "site", "lang", "source", "words", "tokens", "longest_match")


def totals(counted: DataFrame) -> DataFrame:
    """Totals per site, per language, per source and over all: (slice, value, documents, words, tokens, longest_match)."""
    parts = F.explode(F.array(*[F.struct(F.lit(name).alias("slice"), F.col(name).alias("value")) for name in ("site", "lang", "source")],
                              F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")))).alias("s")
    x = counted.select(parts, "words", "tokens", "longest_match")
    return x.groupBy("s.slice", "s.value").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), F.sum("longest_match").alias("longest_match"))
