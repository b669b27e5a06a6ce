"""Token counts: a digest cache of counts; only distinct texts that it lacks are encoded."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Fixed value of the contract.
LIMIT = 1024
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Narrow rows (doc_id, digest) of texts not to encode that may be broadcast; beyond, texts are shuffled.
SKIP_ROWS = 200_000
CACHE = "content binary, tokenizer string, n_tokens long"
#: Characters whose letter, number and space classes no version of Unicode has changed since the
#: libraries exist: Latin, Greek, Cyrillic, common punctuation, CJK. Other texts go to the library itself.
_SETTLED = re.compile("[\x00-ȶΑ-ΡΣ-ώА-я‐-‧‰-⁒₠-€ぁ-ゔァ-ヺ一-龥]*")


class Counter:
    """Counts of the tokens that the library gives for a vocabulary file.

    ``ranks`` may name the same vocabulary as a rank file: texts of settled characters are then
    counted by the faster library that reads it, split at special strings as the first one splits
    them. The two agree on such texts, which the tests check.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = None
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if ranks and plain and spec["normalizer"] is None:
            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ranks = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def count(self, text: str) -> int:
        if self.ranks is not None and _SETTLED.fullmatch(text):
            try:
                return self._fast(text)
            except BaseException as e:  # the faster library's matcher gives up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return len(self.library.encode_batch_fast([text], add_special_tokens=False)[0])

    def _fast(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return len(self.ranks.encode_ordinary(text))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(len(self.ranks.encode_ordinary(p)) for p in parts if p)


@lru_cache(maxsize=4)
def counter(vocabulary: str, ranks: str | None) -> Counter:
    return Counter(vocabulary, ranks)


def tokenizer_digest(vocabulary: str) -> str:
    """The version under which counts are stored: the digest of the vocabulary file."""
    with open(vocabulary, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def count_column(text: Column, vocabulary: str, ranks: str | None) -> Column:
    """Tokens of each text."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([counter(vocabulary, ranks).count(t) for t in texts], dtype="int64")

    return counts(text)


def _content(text: str = "text") -> Column:
    """The normalised content: null is empty. The vocabulary has no normaliser of its own."""
    return F.coalesce(F.col(text), F.lit(""))


def count_documents(docs: DataFrame, cache: str, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, by way of the cache at path ``cache``.

    The cache has rows (content digest, tokenizer digest, count); new counts are appended to it, and
    two jobs that add the same text add equal rows. Texts are matched by SHA-256. Of the rows that
    share a missing text, those with the smallest doc_id are encoded. Texts stay where they are if
    the rows to skip were counted and are few; otherwise they meet the rows to encode in a shuffle.
    Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and doc_ids repeat;
    a null doc_id is an id like any other, the last to be encoded for a text; no rows, no result; other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    if vocabulary is None:
        vocabulary, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    version = tokenizer_digest(vocabulary)
    texts = docs.select("doc_id", _content().alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    keys = common.materialise(texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    first = keys.groupBy("content").agg(F.min("doc_id").alias("first"))
    misses = common.materialise(first.join(stored, "content", "left_anti"), "token-misses")
    missing = misses.select(F.col("content").alias("c"), F.col("first"), F.lit(1).alias("miss"))
    skip = keys.join(missing, (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_anti")
    skip = common.materialise(skip.select(F.col("doc_id").alias("d"), F.col("content").alias("c")).distinct(), "token-skip")
    n_skip = skip.count()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))
    if n_skip <= SKIP_ROWS:
        fresh = texts.join(F.broadcast(skip), same, "left_anti")
    else:
        fresh = texts.join(missing, (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    new = fresh.select("content", count_column(F.col("text"), vocabulary, ranks).alias("n_tokens"))
    new = new.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    # Written, so that both sides of the last join are shuffled for it and a very common text can be split.
    known = common.materialise(known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-known")
    return keys.join(known, "content").select("doc_id", "n_bytes", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`count_documents` over all documents, with a cache that starts empty."""
    cache = f"{common.shared_dir(spark)}/spanloom-token-cache-{uuid.uuid4().hex}"
    counted = count_documents(common.table(spark, sf_dir, "documents"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
