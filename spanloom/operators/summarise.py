"""The extractive summariser: verbatim sentences chosen for aspect coverage and novelty, each with its span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, aspect_queries, sentence_cap
from ..functions.batches import bounded
from ..functions import kernels
from .embedders import Embedder, HashingEmbedder, encoded, token_list

#: One source span of a fact; support is null where the span is authoritative.
SOURCE = "struct<cited_text:string,chunk_ix:int,start:int,end:int,support:double>"
FACTS = f"array<struct<text:string,sources:array<{SOURCE}>>>"
CHUNKS = "array<struct<ix:int,start:int,end:int>>"
RESULT = f"summary string, facts {FACTS}"


_SOURCE = pa.struct([("cited_text", pa.string()), ("chunk_ix", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("support", pa.float64())])
FACTS_ARROW = pa.list_(pa.struct([("text", pa.string()), ("sources", pa.list_(_SOURCE))]))
CHUNKS_ARROW = pa.list_(pa.struct([("ix", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def candidates(text: str, chunks: list[dict], sentences: list[kernels.Span] | None = None, min_chars: int = SETTINGS.min_sentence) -> list[tuple[str, int, int, int]]:
    """(text, chunk, start, end) of the sentences of at least ``min_chars`` that lie in a chunk of (ix, start, end)."""
    if not chunks:
        return []
    spans = [(c["start"], c["end"]) for c in chunks]
    pool = [s for s in (kernels.sentence_spans(text) if sentences is None else sentences) if s[1] - s[0] >= min_chars]
    return [(text[a:b], chunks[k]["ix"], a, b) for (a, b), k in zip(pool, kernels.owners(pool, spans), strict=True) if k is not None]


def _chosen(text: str, spans: list[kernels.Span], words: list[list[str]], asked: np.ndarray, top_k: int, budget: int | None, embedder: Embedder) -> list[dict]:
    """The (ix, start, end) of the chunks that retrieval keeps.

    All statistics of retrieval are a document's own, so a text is chunked, scored and ranked in its row.
    Without a budget a text of few chunks keeps all of them and is not scored.
    """
    kept = range(len(spans))
    if spans and (budget is not None or len(spans) > max(top_k, SETTINGS.top_k_max)):
        parts = [text[a:b] for a, b in spans]
        found = [token_list(p) for p in parts]
        sparse, dense = kernels.scaled(kernels.bm25(found, words)), kernels.scaled(asked @ encoded(embedder, parts, found).T)
        kept, _ = kernels.retrieved(SETTINGS.dense_weight * dense + (1 - SETTINGS.dense_weight) * sparse, top_k, budget)
    return [{"ix": k, "start": spans[k][0], "end": spans[k][1]} for k in kept]


def _facts(owned: list[tuple[str, int, int, int]], asked: np.ndarray, cap: int | None, embedder: Embedder, mine: np.ndarray | None = None) -> list[dict]:
    """Facts of a text from its candidates, whose vectors may be given."""
    if not owned:
        return []
    mine = embedder.encode([c[0] for c in owned]) if mine is None else mine
    picked = sorted(kernels.select(asked @ mine.T, mine, cap or kernels.sentence_budget(len(owned))))
    return [{"text": t, "sources": [{"cited_text": t, "chunk_ix": ix, "start": a, "end": b, "support": None}]} for t, ix, a, b in map(owned.__getitem__, picked)]


def chosen_chunks(text: Column, queries: list[str], top_k: int, budget: int | None, embedder: Embedder) -> Column:
    """The (ix, start, end) of the chunks that retrieval keeps."""
    bounded()

    @F.arrow_udf(CHUNKS)
    def choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        asked, words = embedder.encode(queries), [token_list(q) for q in queries]
        for texts in batches:
            yield pa.array([_chosen(t, kernels.chunk_spans(t), words, asked, top_k, budget, embedder) for t in (t or "" for t in texts.to_pylist())], CHUNKS_ARROW)

    return choose(text)


def chosen_facts(text: Column, chunks_used: Column, queries: list[str], cap: int | None, embedder: Embedder) -> Column:
    """Facts of a text from its selected chunks, given as an array of (ix, start, end) in document order."""
    bounded()

    @F.arrow_udf(FACTS)
    def choose(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        asked = embedder.encode(queries)
        for texts, used in batches:
            rows = zip(texts.to_pylist(), used.to_pylist(), strict=True)
            yield pa.array([_facts(candidates(t or "", c or []), asked, cap, embedder) for t, c in rows], FACTS_ARROW)

    return choose(text, chunks_used)


def summary_parts(text: Column, queries: list[str], top_k: int, budget: int | None, cap: int | None, embedder: Embedder) -> Column:
    """Both in one pass, as a struct (chunks_used, facts): a text is handed over and split once, by one worker."""
    bounded()
    parts = pa.struct([("chunks_used", CHUNKS_ARROW), ("facts", FACTS_ARROW)])

    @F.arrow_udf(f"struct<chunks_used:{CHUNKS},facts:{FACTS}>")
    def choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        asked, words = embedder.encode(queries), [token_list(q) for q in queries]

        def both(text: str) -> dict:
            sentences = kernels.sentence_spans(text)
            chunks = _chosen(text, kernels.chunk_spans(text, sentences), words, asked, top_k, budget, embedder)
            return {"chunks_used": chunks, "facts": _facts(candidates(text, chunks, sentences), asked, cap, embedder)}

        for texts in batches:
            yield pa.array([both(t or "") for t in texts.to_pylist()], parts)

    return choose(text)


def select_chunks(docs: DataFrame, queries: list[str], top_k: int = SETTINGS.top_k, budget: int | None = None, embedder: Embedder | None = None) -> DataFrame:
    """``docs`` (doc_id, text) plus ``chunks_used``: the (ix, start, end) of the chunks that retrieval keeps. Nothing is shuffled."""
    return docs.withColumn("chunks_used", chosen_chunks(F.col("text"), queries, top_k, budget, embedder or HashingEmbedder()))


def summarise_extractive(
    docs: DataFrame, aspects: str | list[str] = "generic", top_k: int = SETTINGS.top_k, chunk_budget: int | None = None,
    max_sentences: int | None = None, length: str | None = None, embedder: Embedder | None = None, chosen: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, text, summary, facts, chunks_used, stop_reason): one row for each document, also an empty one.

    ``chosen`` may be what :func:`select_chunks` has made of the same documents. A null text gives an empty summary.
    """
    embedder, queries = embedder or HashingEmbedder(), aspect_queries(aspects)
    cap = sentence_cap(max_sentences, length)
    if chosen is None:
        parts = docs.select("doc_id", "text", summary_parts(F.col("text"), queries, top_k, chunk_budget, cap, embedder).alias("__p"))
        out = parts.select("doc_id", "text", F.col("__p.chunks_used").alias("chunks_used"), F.col("__p.facts").alias("facts"))
    else:
        out = chosen.withColumn("facts", chosen_facts(F.col("text"), F.col("chunks_used"), queries, cap, embedder))
    summary = F.array_join(F.transform("facts", lambda f: f["text"]), " ")
    stop = F.when(F.size("facts") > 0, "end_turn")
    return out.select("doc_id", "text", summary.alias("summary"), "facts", "chunks_used", stop.alias("stop_reason"))
