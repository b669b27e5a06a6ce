"""Byte-level BPE: overlapping chunks pre-tokenised in parallel, stitched where they agree, and byte-exact decoding.

A text is cut into chunks, and each chunk reads on into the next one by an overlap. A chunk is
pre-tokenised from its own start, so its first boundaries may be wrong; but the pattern looks at
nothing before a match, so every boundary after one that two neighbours share is right. Each chunk
finds the first boundary that it shares with the next one; the pieces between those places are
pre-tokenised and encoded in parallel, every distinct pre-token once, and put together by position.
Texts in which two neighbours share no boundary go round again with larger chunks. Decoding
concatenates raw bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points of a chunk and of the part it shares with the next one; larger chunks grow by a factor.
CHUNK, OVERLAP, GROW = 1 << 16, 1 << 10, 8
RANKS = "byte_bpe_50k.tiktoken"
CODED = "ids binary, decoded binary"
#: Pre-tokens whose ids a worker remembers, and the longest of them.
CACHED, CACHED_CHARS = 1 << 16, 64


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file; loaded once in each process."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes by token id."""
    enc = encoding(path)
    out = [b""] * (enc.max_token_value + 1)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = token
    return out


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class _Ids(dict):
    """Packed ids by pre-token; pre-tokens are context-free, so each is merged once while it is remembered."""

    def __init__(self, path: str):
        self.merge = encoding(path)._encode_single_piece

    def __missing__(self, token: str) -> bytes:
        ids = self.merge(token)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[token] = packed
        return packed


@lru_cache(maxsize=4)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def encode_piece(text: str | None, path: str, start: int = 0, end: int | None = None) -> bytes:
    """Ids of the pre-tokens from the boundary ``start`` to the boundary ``end``, as little-endian unsigned 32-bit integers.

    What follows ``end`` is still read, as a match may look past its end.
    """
    if not text:
        return b""
    tokens = _pattern(public_tokenizers.PATTERN).findall(text, start)
    if end is not None and end < len(text):
        size = len(text) - end
        while size > 0:
            size -= len(tokens.pop())
    return b"".join(map(_ids(path).__getitem__, tokens))


def decode_ids(ids: bytes | None, path: str) -> bytes:
    """The raw bytes of packed token ids."""
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


# ---------------------------------------------------------------- chunks


def chunk_rows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(number, text) of the overlapping chunks; the last one has no overlap."""
    for k, start in enumerate(range(0, len(text), chunk)):
        yield k, text[start : start + chunk + overlap]


def boundaries(part: str, cut: bool) -> np.ndarray:
    """Ends of the pre-tokens of ``part``; of a cut one only those that no character after the cut can change.

    A match looks at most one character past its end, and a contraction two past its start.
    """
    ends = np.cumsum(np.fromiter(map(len, _pattern(public_tokenizers.PATTERN).findall(part)), np.int64))
    return ends[ends <= len(part) - 2] if cut else ends


def meeting(part: str, chunk: int) -> int | None:
    """The first boundary that a chunk shares with the one that begins at ``chunk``; None if they share none."""
    shared = np.intersect1d(boundaries(part, True), chunk + boundaries(part[chunk:], True), assume_unique=True)
    return int(shared[0]) if len(shared) else None


def _cut(chunk: int, overlap: int):
    """mapInPandas over (key, text): a row for every chunk."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                held, size = [], 0
                for k, part in chunk_rows(text, chunk, overlap):
                    held.append((key, k, part))
                    size += len(part)
                    if size >= 1 << 20:
                        yield pd.DataFrame(held, columns=["key", "k", "part"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["key", "k", "part"])

    return rows


def _meetings(part: Column, chunk: int) -> Column:
    @F.pandas_udf("int")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series([meeting(p, chunk) if len(p) > chunk else None for p in parts], dtype="Int32")

    return places(part)


def _piece_ids(part: Column, start: Column, end: Column, path: str) -> Column:
    @F.pandas_udf("binary")
    def ids(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts, starts, ends in batches:
            yield pd.Series([encode_piece(p, path, int(a), int(b)) for p, a, b in zip(parts, starts, ends, strict=True)], dtype=object)

    return ids(part, start, end)


def _joined(pieces: Column, path: str) -> Column:
    """Ids and decoded bytes of the pieces of a text."""

    @F.pandas_udf(CODED)
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = [b"".join(bytes(p["ids"]) for p in row) for row in rows]
            yield pd.DataFrame({"ids": ids, "decoded": [decode_ids(i, path) for i in ids]})

    return whole(pieces)


def _long_ids(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, coded) of the distinct texts of (key, text), each longer than ``chunk``; key is a digest of the text."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = texts.mapInPandas(_cut(chunk, overlap), "key string, k int, part string")
    # Copies of a text meet before the shuffle; what is left is spread by chunk.
    parts = common.materialise(parts.groupBy("key", "k").agg(F.first("part").alias("part")), "bpe-chunks")
    dealt = parts.repartition(n, "key", "k")
    met = dealt.select("key", "k", (F.length("part") > chunk).alias("more"), _meetings(F.col("part"), chunk).alias("at"))
    met = common.materialise(met, "bpe-meetings")
    apart = common.materialise(met.where("more and at is null").select("key").distinct(), "bpe-apart")
    # The place where a chunk begins is where the one before it met it.
    starts = met.select(F.col("key").alias("key_"), (F.col("k") + 1).alias("k_"), (F.col("at") - chunk).alias("start"))
    pieces = (
        parts.join(met.select("key", "k", "at"), ["key", "k"])
        .join(starts, (F.col("key") == F.col("key_")) & (F.col("k") == F.col("k_")), "left").drop("key_", "k_")
        .join(apart.withColumnRenamed("key", "key_"), F.col("key") == F.col("key_"), "left_anti")
    )
    end = F.coalesce("at", F.length("part"))
    pieces = pieces.select("key", "k", _piece_ids(F.col("part"), F.coalesce("start", F.lit(0)), end, path).alias("ids"))
    out = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("pieces"))
    out = out.select("key", _joined(F.col("pieces"), path).alias("coded"))
    if apart.isEmpty():
        return out
    again = texts.join(apart, "key", "left_semi")
    longer = F.length("text") > chunk * GROW
    whole = again.where(~longer).groupBy("key").agg(F.first("text").alias("text"))
    return out.unionByName(whole.select("key", encode_and_decode(F.col("text"), path).alias("coded"))).unionByName(
        _long_ids(again.where(longer), path, chunk * GROW, overlap * GROW)
    )


# ---------------------------------------------------------------- columns and frames


def encode(text: Column, path: str) -> Column:
    """Packed ids of a column of texts or pieces: 4 bytes a token."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode_piece(t, path) for t in texts], dtype=object)

    return ids(text)


def encode_and_decode(text: Column, path: str) -> Column:
    """A struct of packed ids and of their raw bytes, in one pass through the workers."""

    @F.pandas_udf(CODED)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = [encode_piece(t, path) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [decode_ids(i, path) for i in ids]})

    return both(text)


def decode(ids: Column, path: str) -> Column:
    """Raw bytes of a packed id column; bytes, as ids cut anywhere need not be valid UTF-8. No ids or null: no bytes."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for packed in batches:
            yield pd.Series([decode_ids(p, path) for p in packed], dtype=object)

    return raw(ids)


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` plus ``__ids`` (packed token ids) and ``__decoded`` (their bytes).

    A text of one chunk has no neighbours to agree with and stays where it is; the chunks of longer
    texts are spread over all tasks, so one very long text does not wait for one core. Defined cases:
    null and empty texts have no ids and decode to no bytes; repeated rows repeat; an empty table
    stays empty; other columns pass through, and where one already has the name of a new column, the
    new one gets underscores behind it.
    """
    if not 4 <= overlap <= chunk:
        raise ValueError("an overlap has at least 4 code points and at most those of a chunk")
    path = path or public_tokenizers.path(RANKS)
    common.small_batches(docs.sparkSession)
    key, coded, ids, decoded = common.fresh(docs, "__key", "__coded", "__ids", "__decoded")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    out = docs.where(~is_long).withColumn(coded, encode_and_decode(F.col("text"), path))
    long_docs = docs.where(is_long).withColumn(key, F.sha2("text", 256))
    if not long_docs.isEmpty():
        found = common.materialise(_long_ids(long_docs.select(F.col(key).alias("key"), "text"), path, chunk, overlap), "bpe-ids")
        found = found.select(F.col("key").alias(key), F.col("coded").alias(coded))
        out = out.unionByName(long_docs.join(found, key).select(*[F.col(f"`{c}`") for c in docs.columns], coded))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{coded}.ids").alias(ids), F.col(f"{coded}.decoded").alias(decoded))


def token_digests(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes of every row; cases as above."""
    return encode_documents(docs.select("doc_id", "text"), path, chunk, overlap).select(
        "doc_id",
        (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2("__decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`encode_documents` over all documents."""
    return token_digests(common.table(spark, sf_dir, "documents"))
