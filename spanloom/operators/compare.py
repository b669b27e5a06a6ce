"""Backends compared on the same documents."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, aspect_queries
from ..functions import kernels, plain
from ..functions.batches import bounded
from .backends import Generator, Request, block_json, checked_reply, request
from .embedders import Embedder, HashingEmbedder, token_list
from .ground import _check_claims, _grounded, _shifted, _sides, parse_claims, plain_claims
from .metrics import FACT_SCORES, SCORES, fact_scores, rouge_scores, source_forms
from .summarise import CHUNKS, CHUNKS_ARROW, _chosen, _facts, candidates

#: One backend's scores of a document; the summary is kept only where a reference asks for it.
_SCORED = f"struct<backend:string,summary:string,{FACT_SCORES.replace(', ', ',').replace(' ', ':')},failed:boolean,error:string>"
_RATES, _COUNTS = SCORES[3:6], SCORES[6:]
_SCORED_ARROW = pa.struct([
    ("backend", pa.string()), ("summary", pa.string()), *[(n, pa.float64()) for n in _RATES], *[(n, pa.int32()) for n in _COUNTS],
    ("failed", pa.bool_()), ("error", pa.string()),
])
#: All backends' scores; where the verified one's reply is left to the engine's parser, the reply as it came and the chunks instead.
_PASS = f"struct<scored:array<{_SCORED}>,chunks_used:{CHUNKS},content:string>"
_PASS_ARROW = pa.struct([("scored", pa.list_(_SCORED_ARROW)), ("chunks_used", CHUNKS_ARROW), ("content", pa.string())])


def _scored(backend: str, summary: str, facts: list[dict], text: str, forms: set[str], refusal: str | None = None, error: str | None = None, keep: bool = False) -> dict:
    failed = error is not None or refusal is not None
    return {
        "backend": backend, "summary": summary if keep else None, **fact_scores(summary, facts, text, forms),
        "failed": failed, "error": refusal if error is None else error,
    }


#: What stands between the facts of a summary that is made of them.
JOINED = {"extractive": " ", "api": "", "verified": " "}


def _joined(facts: list[dict], by: str) -> str:
    return by.join(f["text"] for f in facts)


def _all_backends(text: Column, names: list[str], asked: dict[str, Request], queries: list[str], embedder: Embedder, keep: bool) -> Column:
    """A document under every backend in one pass of one worker.

    It is split, chunked and ranked once, its candidates are embedded once for the extractive summary and all
    grounding, and the numbers of the source are read once. Equal replies are grounded and scored once.
    """
    bounded()

    def scored(text: str, sentences: list, chunks: list[dict], replies: dict[str, dict], vectors: np.ndarray) -> dict:
        pool = candidates(text, chunks, sentences)
        sides = _sides(pool, embedder) if pool else None
        forms, grounded, out = source_forms(text), {}, {"scored": []}
        for name in names:
            if name == "extractive":
                facts = _facts(pool, vectors, None, embedder, sides and sides[1])
                out["scored"].append(_scored(name, _joined(facts, JOINED[name]), facts, text, forms, keep=keep))
                continue
            reply = replies[name]
            content, error, refused = reply.get("content") or "", reply.get("error"), reply.get("stop_reason") == "refusal"
            refusal, facts = content if refused else None, []
            said = "" if refused or name in ("api", "verified") else plain.strip_artifacts(content)
            if not refused and error is None:
                if name == "api":
                    facts = _shifted(reply.get("blocks"), chunks)
                elif name == "verified":
                    claims = plain_claims(content) if content else []
                    if claims is None:
                        out |= {"chunks_used": chunks, "content": content}
                        continue
                    facts = _check_claims(claims, text, chunks)[0]
                else:
                    if said not in grounded:
                        grounded[said] = _scored(name, said, _grounded(said, pool, embedder, sides), text, forms, keep=keep)
                    out["scored"].append(grounded[said] | {"backend": name})
                    continue
            out["scored"].append(_scored(name, _joined(facts, JOINED[name]) if name in JOINED else said, facts, text, forms, refusal, error, keep))
        return out

    @F.arrow_udf(_PASS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, words = embedder.encode(queries), [token_list(q) for q in queries]
        for column in batches:
            rows = []
            for text in column.to_pylist():
                text = text or ""
                sentences = kernels.sentence_spans(text)
                chunks = _chosen(text, kernels.chunk_spans(text, sentences), words, vectors, SETTINGS.top_k, None, embedder)
                excerpts = [text[c["start"] : c["end"]] for c in chunks]
                replies = {name: checked_reply(ask.reply(excerpts, block_json(text, chunks) if name == "api" else None)) for name, ask in asked.items()}
                rows.append(scored(text, sentences, chunks, replies, vectors))
            yield pa.array(rows, _PASS_ARROW)

    return run(text)


def _verified(claims: Column, text: Column, chunks_used: Column, keep: bool) -> Column:
    """The verified backend's scores from the claims of its reply; null for null claims."""
    bounded()

    @F.arrow_udf(_SCORED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for said, source, chunks in zip(*[column.to_pylist() for column in batch], strict=True):
                facts = None if said is None else _check_claims(said, source, chunks)[0]
                out.append(None if facts is None else _scored("verified", _joined(facts, JOINED["verified"]), facts, source, source_forms(source), keep=keep))
            yield pa.array(out, _SCORED_ARROW)

    return run(claims, text, chunks_used)


def compare(docs: DataFrame, backends: dict[str, Generator | None], aspects: str | list[str] = "generic", reference: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """(backend, doc_id, scores..., failed, error): every document scored under every backend.

    A document is read, split and ranked once for all backends. One that fails or is refused is a row with ``failed``.
    """
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    asked = {name: request(name, generator, tasks) for name, generator in backends.items() if name != "extractive"}
    extra = [F.col(reference).alias("__ref")] if reference else []
    passed = _all_backends(F.col("text"), list(backends), asked, aspect_queries(aspects), embedder or HashingEmbedder(), bool(extra))
    df = docs.select("doc_id", "text", *extra).withColumn("__p", passed)
    scored = F.col("__p.scored")
    if "verified" in backends:
        odd = F.col("__p.content").isNotNull()
        df = df.withColumn("__c", F.when(odd, parse_claims(F.col("__p.content")))).withColumn("__t", F.when(odd, F.col("text")))
        df = df.withColumn("__v", _verified(F.col("__c"), F.col("__t"), F.col("__p.chunks_used"), bool(extra)))
        scored = F.when(F.col("__v").isNull(), scored).otherwise(F.concat(scored, F.array("__v")))
    df = df.select("doc_id", *["__ref"] * bool(extra), F.explode(scored).alias("__s")).select("doc_id", *["__ref"] * bool(extra), "__s.*")
    rouge = rouge_scores(F.col("summary"), F.col("__ref") if extra else None)
    rates = [*rouge, *[F.col(n) for n in _RATES]]
    values = [*[F.round(r, 4) for r in rates], *[F.col(n) for n in _COUNTS]]
    return df.select("backend", "doc_id", *[v.alias(n) for v, n in zip(values, SCORES, strict=True)], "failed", "error")


def rollup(scores: DataFrame) -> DataFrame:
    """(backend, failed, error, mean scores over documents that succeeded, n_docs), in one pass over the scores."""
    good = ~F.col("failed")
    means = [F.round(F.avg(F.when(good, F.col(n))), 4).alias(n) for n in SCORES]
    n_docs = F.count_if(good)
    failed, error = F.sum(F.col("failed").cast("int")).alias("failed"), F.min("error").alias("error")
    return scores.groupBy("backend").agg(failed, error, *means, F.when(n_docs > 0, n_docs).alias("n_docs"))


def timed(docs: DataFrame, backends: dict[str, Generator | None], **how) -> list[dict]:
    """Rollup rows with the seconds of each backend, chunking and retrieval included."""
    rows = []
    for name, generator in backends.items():
        began = time.monotonic()
        row = rollup(compare(docs, {name: generator}, **how)).first().asDict()
        seconds = time.monotonic() - began
        rows.append(row | {"seconds": round(seconds, 3), "sec_per_doc": round(seconds / row["n_docs"], 4) if row["n_docs"] else None})
    return rows
