"""Hybrid retrieval inside each document: BM25 and cosine over its chunks, blended and ranked.

Statistics are per document, never of the corpus, so every step is partitioned by doc_id. Queries are
a short list given by the caller and enter plans as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import kernels
from ..functions.batches import bounded
from ..functions.text import TOKEN, tokens
from .embedders import _TOKENS, Embedder, HashingEmbedder, encoded


def embed(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, by batches in the Python workers."""

    bounded()
    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.encode([t or "" for t in texts])), dtype=object)

    return vectors(text)


def cosines(text: Column, queries: list[str], embedder: Embedder) -> Column:
    """Cosine of each text to every query, as an array; the vectors stay in the Python worker."""

    bounded()
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        asked = embedder.encode(queries).T
        for texts in batches:
            yield pd.Series(list(embedder.encode([t or "" for t in texts]) @ asked), dtype=object)

    return run(text)


def query_table(df: DataFrame, queries: list[str], embedder: Embedder | None = None) -> DataFrame:
    """(query_ix, query, terms, vector) for a caller's list of queries."""
    vectors = embedder.encode(queries).tolist() if embedder else [None] * len(queries)
    rows = [(k, q, re.findall(TOKEN, q.lower()), v) for k, (q, v) in enumerate(zip(queries, vectors, strict=True))]
    return df.sparkSession.createDataFrame(rows, "query_ix int, query string, terms array<string>, vector array<double>")


def bm25(chunk_rows: DataFrame, queries: list[str], k1: float = SETTINGS.bm25_k1, b: float = SETTINGS.bm25_b, epsilon: float = SETTINGS.bm25_epsilon) -> DataFrame:
    """(doc_id, query_ix, chunk_ix, sparse_score) where a query term occurs; other pairs score 0.

    A term's weight is ln(N - df + 0.5) - ln(df + 0.5) over the document's N chunks; negative weights
    become epsilon times the mean weight of the document's terms. A repeated query term counts again.
    """
    n = int(chunk_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    toks = chunk_rows.select("doc_id", "chunk_ix", tokens(F.col("text")).alias("t")).repartition(n, "doc_id")
    # One shuffle, by document; all windows and counts below are inside a document and reuse it.
    doc, term = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "term")
    toks = toks.withColumn("dl", F.size("t")).withColumn("n", F.count("*").over(doc)).withColumn("avgdl", F.avg("dl").over(doc))
    rows = toks.select("doc_id", "chunk_ix", "dl", "n", "avgdl", F.explode("t").alias("term"))
    rows = rows.groupBy("doc_id", "chunk_ix", "dl", "n", "avgdl", "term").agg(F.count("*").alias("tf"))
    rows = rows.withColumn("df", F.count("*").over(term))
    rows = rows.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # a term stands in df rows, so weights of 1 / df make this the mean over distinct terms
    mean = F.sum(F.col("idf") / F.col("df")).over(doc) / F.sum(1 / F.col("df")).over(doc)
    rows = rows.withColumn("weight", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf")))
    asked = [(k, t, c) for k, q in enumerate(queries) for t, c in _counts(re.findall(TOKEN, q.lower())).items()]
    asked = chunk_rows.sparkSession.createDataFrame(asked, "query_ix int, term string, times int")
    hits = rows.join(F.broadcast(asked), "term")  # a row for each term of the caller's queries
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("times") * F.col("weight") * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl"))))
    return hits.groupBy("doc_id", "query_ix", "chunk_ix").agg(F.sum(part).alias("sparse_score"))


def _counts(terms: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in terms:
        out[t] = out.get(t, 0) + 1
    return out


def minmax(score: str, *keys: str) -> Column:
    """A score scaled to 0..1 within its group; all 0 where the range is nothing."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < SETTINGS.flat_range, 0.0).otherwise((F.col(score) - lo) / (hi - lo))


def scored(chunk_rows: DataFrame, queries: list[str], embedder: Embedder | None = None) -> DataFrame:
    """(doc_id, query_ix, chunk_ix, score, dense_score, sparse_score) of every query and chunk of a document."""
    scores = cosines(F.col("text"), queries, embedder or HashingEmbedder())
    dense = chunk_rows.select("doc_id", "chunk_ix", F.posexplode(scores).alias("query_ix", "dense_score"))
    both = dense.join(bm25(chunk_rows, queries), ["doc_id", "query_ix", "chunk_ix"], "left").na.fill(0.0, ["sparse_score"])
    keys, w = ("doc_id", "query_ix"), SETTINGS.dense_weight
    blend = w * minmax("dense_score", *keys) + (1 - w) * minmax("sparse_score", *keys)
    return both.select(*keys, "chunk_ix", blend.alias("score"), "dense_score", "sparse_score")


def best_first() -> list[Column]:
    """By score, then by place. Scores are compared to nine digits: what differs only by the order of a sum is a tie."""
    return [F.round("score", 9).desc(), F.col("chunk_ix")]


def top(scores: DataFrame, k: int | Column) -> DataFrame:
    """The best ``k`` chunks of each document for each query, with their rank; ties go to the earlier chunk."""
    order = Window.partitionBy("doc_id", "query_ix").orderBy(*best_first())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(chunk_rows: DataFrame, queries: list[str], top_k: int = SETTINGS.top_k, embedder: Embedder | None = None) -> DataFrame:
    """The best ``top_k`` chunks of each document for each query by their blended score."""
    return top(scored(chunk_rows, queries, embedder), top_k)


def effective_top_k(n: Column, top_k: int = SETTINGS.top_k) -> Column:
    """A document of more than ``top_k`` chunks is ranked whole, up to the fixed most."""
    return F.when(n <= top_k, F.lit(top_k)).otherwise(F.least(n, F.lit(SETTINGS.top_k_max)))


def search_many(chunk_rows: DataFrame, queries: list[str], top_k: int = SETTINGS.top_k, budget: int | None = None, embedder: Embedder | None = None) -> DataFrame:
    """(doc_id, chunk_ix, score): chunks that any query ranks high, by best score up to ``budget``.

    Without a budget, a document of at most the fixed most chunks keeps all of them whatever their
    scores; such documents are not scored at all and have a null score.
    """
    counts = chunk_rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = chunk_rows.join(counts, "doc_id")
    whole = F.col("n") <= effective_top_k(F.col("n"), top_k)
    if budget is not None:
        whole = F.lit(False)
    passed = rows.where(whole).select("doc_id", "chunk_ix", F.lit(None).cast("double").alias("score"))
    ranked = rows.where(~whole)
    hits = top(scored(ranked.drop("n"), queries, embedder).join(counts, "doc_id"), effective_top_k(F.col("n"), top_k))
    best = hits.groupBy("doc_id", "chunk_ix").agg(F.max("score").alias("score"))
    if budget is not None:
        by_score = Window.partitionBy("doc_id").orderBy(*best_first())
        best = best.withColumn("__r", F.row_number().over(by_score)).where(F.col("__r") <= budget).drop("__r")
    return passed.unionByName(best)


def _scores(parts: list[str], words: list[list[str]], asked: np.ndarray | None, embedder: Embedder) -> tuple[np.ndarray, list[list[str]]]:
    """Scores (query, unit) of one document's units, blended if vectors of the queries are given, and the units' tokens."""
    found = [_TOKENS.findall(p.lower()) for p in parts]
    sparse = kernels.bm25(found, words)
    if asked is None:
        return sparse, found
    dense = kernels.scaled(asked @ encoded(embedder, parts, found).T)
    return SETTINGS.dense_weight * dense + (1 - SETTINGS.dense_weight) * kernels.scaled(sparse), found


Splitter = Callable[[str], list[kernels.Span]]


def search_rows(docs: DataFrame, split: Splitter, queries: list[str], top_k: int = SETTINGS.top_k, embedder: Embedder | None = None, dense: bool = True) -> DataFrame:
    """(doc_id, query_ix, chunk_ix, rank, score): :func:`search` over the units into which ``split`` cuts each text.

    A document is split, scored and ranked in its row, so nothing is shuffled and a task holds one document.
    Without ``dense`` units are ranked by BM25 alone, and only those that have a term of the query.
    """
    bounded()
    embedder = embedder or HashingEmbedder()

    @F.arrow_udf("array<struct<query_ix:int,chunk_ix:int,rank:int,score:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = [_TOKENS.findall(q.lower()) for q in queries]
        asked = embedder.encode(queries) if dense else None

        def hits(text: str) -> list[dict]:
            spans = split(text)
            if not spans:
                return []
            scores, found = _scores([text[a:b] for a, b in spans], words, asked, embedder)
            out = []
            for q, row in enumerate(scores):
                order = np.argsort(-row.round(9), kind="stable")
                if not dense:
                    order = order[np.array([not t.isdisjoint(words[q]) for t in map(set, found)])[order]]
                out += [{"query_ix": q, "chunk_ix": int(k), "rank": r + 1, "score": float(row[k])} for r, k in enumerate(order[:top_k])]
            return out

        for texts in batches:
            yield pa.array([hits(t or "") for t in texts.to_pylist()], run_type)

    run_type = pa.list_(pa.struct([("query_ix", pa.int32()), ("chunk_ix", pa.int32()), ("rank", pa.int32()), ("score", pa.float64())]))
    return docs.select("doc_id", F.explode(run("text")).alias("h")).select("doc_id", "h.*")


def search_many_rows(docs: DataFrame, split: Splitter, queries: list[str], top_k: int = SETTINGS.top_k, budget: int | None = None, embedder: Embedder | None = None) -> DataFrame:
    """(doc_id, chunk_ix, score): :func:`search_many` over the units of each text, in its row."""
    bounded()
    embedder = embedder or HashingEmbedder()
    run_type = pa.list_(pa.struct([("chunk_ix", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<chunk_ix:int,score:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, asked = [_TOKENS.findall(q.lower()) for q in queries], embedder.encode(queries)

        def hits(text: str) -> list[dict]:
            spans = split(text)
            if not spans:
                return []
            if budget is None and len(spans) <= max(top_k, SETTINGS.top_k_max):
                return [{"chunk_ix": k, "score": None} for k in range(len(spans))]
            blend, _ = _scores([text[a:b] for a, b in spans], words, asked, embedder)
            return [{"chunk_ix": k, "score": x} for k, x in zip(*kernels.retrieved(blend, top_k, budget), strict=True)]

        for texts in batches:
            yield pa.array([hits(t or "") for t in texts.to_pylist()], run_type)

    return docs.select("doc_id", F.explode(run("text")).alias("h")).select("doc_id", "h.*")


#: Rows of one cell, which is one dense product: vectors and queries.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 10_000
#: Of a product that is looked through at once: its queries; and pairs whose cosines are summed at once.
_STRIP, _PAIRS = 128, 65_536


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, top_k: int) -> DataFrame:
    """Exact nearest vectors of a query set: (query_id, hit_id, cosine, rank); ties go to the smaller key.

    ``queries`` has the same columns. Both sides are counted and dealt by a hash into blocks of about the
    sizes above; every block of vectors meets every block of queries in a cell, which hands on ``top_k`` rows
    a query. The number of pairs is that of the two sides multiplied; a task holds one cell.
    """
    n_v = max(4, -(-vectors.count() // VECTOR_BLOCK))
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    element = vectors.schema[vector].dataType.elementType.typeName()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"

    def dealt(df: DataFrame, own: int, other: int, place: Callable[[Column, Column], Column]) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(own))).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        # more partitions than cells, so that few cells share one
        return rows.select(place(F.col("block"), F.col("met")).cast("int").alias("cell"), "id", "v").repartition(4 * n_v * n_q, "cell")

    sides = dealt(vectors, n_v, n_q, lambda b, m: b * n_q + m), dealt(queries, n_q, n_v, lambda b, m: m * n_q + b)
    id_type = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {id_type}, hit_id {id_type}, cosine double"
    hits = sides[0].groupBy("cell").cogroup(sides[1].groupBy("cell")).applyInArrow(partial(_nearest, top_k=top_k), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "hit_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _by_length(lists: pa.ListArray) -> dict[int, np.ndarray]:
    """Row numbers by the length of their list; lists that are null or hold a null are left out."""
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).copy()
    holes = pc.is_null(pc.list_flatten(lists)).to_numpy(zero_copy_only=False)
    length[pc.list_parent_indices(lists).to_numpy()[holes]] = -1
    return {int(n): np.flatnonzero(length == n) for n in np.unique(length) if n >= 0}


def _matrix(lists: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    return pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _nearest(left: pa.Table, right: pa.Table, top_k: int) -> pa.Table:
    """The ``top_k`` rows of ``left`` nearest to each row of ``right``, by cosine and then by key."""
    ids, asked = left.column("id").combine_chunks(), right.column("id").combine_chunks()
    vectors, queries = (t.column("v").combine_chunks() for t in (left, right))
    by_key = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
    place = np.empty(len(ids), np.int64)
    place[by_key] = np.arange(len(ids))
    of_vectors, of_queries, found = _by_length(vectors), _by_length(queries), []
    for width, rows in of_queries.items():
        if width in of_vectors:
            mine = of_vectors[width]
            for q, v, x in _pairs(_matrix(vectors, mine, width), place[mine], _matrix(queries, rows, width), top_k):
                found.append((rows[q], mine[v], x, np.zeros(len(q), bool)))
    # A pair of other lengths, or with a null, has no cosine and comes last.
    for width, rows in [*of_queries.items(), (-1, np.setdiff1d(np.arange(len(asked)), np.concatenate([*of_queries.values(), np.empty(0, int)])))]:
        mine = of_vectors.get(width, np.empty(0, int))
        if len(rows) and len(mine) < top_k:
            rest = by_key[~np.isin(by_key, mine)][:top_k]
            found.append((np.repeat(rows, len(rest)), np.tile(rest, len(rows)), np.zeros(len(rows) * len(rest)), np.ones(len(rows) * len(rest), bool)))
    q, v, x, none = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, bool))
    return pa.table({"query_id": asked.take(pa.array(q)), "hit_id": ids.take(pa.array(v)), "cosine": pa.array(x, mask=none)})


def _pairs(vectors: np.ndarray, place: np.ndarray, queries: np.ndarray, top_k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, cosine) of the nearest rows, strip by strip of queries.

    Equal vectors are compared once and stand for their first ``top_k`` rows. A product of matrices names
    the candidates, with more room than it can err by; their cosines are then summed from the left.
    """
    n, width = vectors.shape
    _, first, inverse = np.unique(np.ascontiguousarray(vectors).view(f"V{max(1, width * vectors.itemsize)}").ravel() if width else np.zeros(n), return_index=True, return_inverse=True)
    order = np.lexsort((place, inverse))
    starts = np.searchsorted(inverse[order], np.arange(len(first)))
    sizes = np.minimum(np.diff(np.append(starts, n)), top_k)
    apart, queries = vectors[first].astype(float), queries.astype(float)
    wild, odd = ~np.isfinite(apart).all(axis=1), ~np.isfinite(queries).all(axis=1)
    tame = np.where(wild[:, None], 0.0, apart)
    with np.errstate(over="ignore"):
        longest = np.sqrt((tame * tame).sum(axis=1)).max()
    for at in range(0, len(queries), _STRIP):
        with np.errstate(invalid="ignore", over="ignore"):
            mine = np.where(odd[at : at + _STRIP, None], 0.0, queries[at : at + _STRIP])
            near = mine @ tame.T
            near[:, wild] = -np.inf
            slack = 4 * (width + 4) * np.finfo(float).eps * longest * np.sqrt((mine * mine).sum(axis=1))
            least = np.partition(near, -top_k, axis=1)[:, -top_k] - slack if near.shape[1] > top_k else np.full(len(mine), -np.inf)
        # what is not finite is a candidate everywhere
        q, d = np.nonzero(~(near < least[:, None]) | wild | odd[at : at + _STRIP, None])
        with np.errstate(invalid="ignore", over="ignore"):
            parts = [np.cumsum(queries[at + q[i : i + _PAIRS]] * apart[d[i : i + _PAIRS]], axis=1)[:, -1] + 0.0 if width else np.zeros(len(q[i : i + _PAIRS])) for i in range(0, len(q), _PAIRS)]
        x, copies = np.concatenate([*parts, np.empty(0)]), sizes[d]
        row = order[np.repeat(starts[d], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)]
        q, x = np.repeat(q, copies), np.repeat(x, copies)
        best = np.lexsort((place[row], -x, ~np.isnan(x), q))
        q, row, x = q[best], row[best], x[best]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < top_k
        yield at + q[kept], row[kept], x[kept]
