"""Grounding: generated claims tied to source spans by similarity, by quotation, or by native citations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.batches import bounded
from ..functions import kernels, plain
from ..functions.text import TYPOGRAPHIC, fold_typography, quote_pattern, strip, strip_artifacts, tokens
from .embedders import Embedder, HashingEmbedder, encoded, token_list
from .summarise import FACTS, FACTS_ARROW, candidates

CLAIMS = "array<struct<claim:string,quote:string>>"


# ---------------------------------------------------------------- by similarity


Candidates = list[tuple[str, int, int, int]]


def _sides(pool: Candidates, embedder: Embedder) -> tuple[list[list[str]], np.ndarray]:
    """Tokens and vectors of candidates."""
    found = [token_list(text) for text, *_ in pool]
    return found, encoded(embedder, [p[0] for p in pool], found)


def _supports(claims: list[str], pool: Candidates, embedder: Embedder, sides: tuple[list[list[str]], np.ndarray] | None = None) -> list[list[dict]]:
    """Sources of each claim: at most three candidates close to its best one, in document order.

    Tokens and vectors are made once for each side, those of the pool perhaps by the caller. One claim meets
    all candidates at a time, so memory grows with their sum, not their product. Scores are compared to nine
    digits, so that a score which is the threshold but for the order of a sum reaches it.
    """
    if not claims or not pool:
        return [[] for _ in claims]
    found, vectors = sides or _sides(pool, embedder)
    said, w, out = [token_list(claim) for claim in claims], SETTINGS.align_dense_weight, []
    for mine, vector in zip(map(set, said), encoded(embedder, claims, said), strict=True):
        shared = np.fromiter(map(len, map(mine.intersection, found)), float, len(pool))
        score = (w * (vectors @ vector) + (1 - w) * (shared / len(mine) if mine else shared)).round(9)
        near = np.argsort(-score, kind="stable")[: SETTINGS.align_spans]
        floor = max(SETTINGS.align_threshold, (score[near[0]] - SETTINGS.align_margin).round(9))
        kept = sorted((int(k) for k in near if score[k] >= floor), key=lambda k: pool[k][2])
        out.append([{"cited_text": pool[k][0], "chunk_ix": pool[k][1], "start": pool[k][2], "end": pool[k][3], "support": round(float(score[k]), 4)} for k in kept])
    return out


def _grounded(said: str, pool: Candidates, embedder: Embedder, sides: tuple[list[list[str]], np.ndarray] | None = None) -> list[dict]:
    """The sentences of a generated summary with their sources."""
    claims = [said[a:b] for a, b in kernels.sentence_spans(said)]
    return [{"text": c, "sources": s} for c, s in zip(claims, _supports(claims, pool, embedder, sides), strict=True)]


def ground(summary: Column, text: Column, chunks_used: Column, embedder: Embedder | None = None, min_chars: int = SETTINGS.min_sentence) -> Column:
    """Facts of a generated summary: its sentences, each with the source sentences that support it.

    Candidates are the sentences of the chunks that the generator saw. A claim without support is
    kept without sources.
    """
    embedder = embedder or HashingEmbedder()

    bounded()
    @F.arrow_udf(FACTS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for said, source, chunks in zip(*[column.to_pylist() for column in batch], strict=True):
                said = said or ""
                out.append(_grounded(said, candidates(source or "", chunks or [], min_chars=min_chars) if said.strip() else [], embedder))
            yield pa.array(out, FACTS_ARROW)

    return run(summary, text, chunks_used)


# ---------------------------------------------------------------- by quotation


def parse_claims(content: Column) -> Column:
    """Claims of a model's reply: an object with ``claims``, a bare list, or the outermost braces in prose."""
    bare = strip_artifacts(F.coalesce(content, F.lit("")))
    holder = f"struct<claims:{CLAIMS}>"
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    whole = F.when(bare.startswith("["), F.from_json(bare, CLAIMS)).when(bare.startswith("{"), F.from_json(bare, holder)["claims"])
    found = F.coalesce(whole, F.from_json(F.when(braces != "", braces), holder)["claims"], F.from_json(F.lit("[]"), CLAIMS))
    return F.filter(found, lambda c: F.coalesce(c["claim"], F.lit("")) != "")


_SURROGATE = re.compile("[\ud800-\udfff]")
#: Longer replies are left to the engine's parser, which has limits of its own.
_PLAIN_REPLY = 1 << 20


def plain_claims(content: str) -> list[dict] | None:
    """What :func:`parse_claims` reads from a reply that is only an object of claims of two strings each; None for any other.

    Such a reply has one reading. Others (prose around the object, other types, fields named twice) are the engine's to read.
    """
    bare = plain.strip_artifacts(content)
    if not bare.startswith("{") or len(bare) > _PLAIN_REPLY:
        return None
    try:
        (key, entries), *more = json.loads(bare, object_pairs_hook=tuple)
    except ValueError:
        return None
    if more or key != "claims" or type(entries) is not list:
        return None
    out = []
    for entry in entries:
        if type(entry) is not tuple or [name for name, _ in entry] != ["claim", "quote"] or not all(type(v) is str and not _SURROGATE.search(v) for _, v in entry):
            return None
        out.append(dict(entry))
    return [c for c in out if c["claim"]]


def locate_quotes(quotes: DataFrame, chunk_rows: DataFrame, *keys: str) -> DataFrame:
    """``quotes`` (keys..., quote) plus chunk_ix, start and end of the first chunk that holds it; null if none does.

    ``chunk_rows`` has the keys and chunk_ix, start, text. Typographic variants and white space are
    matched loosely, case is not. A quote under the least length is never found.
    """
    # Equal quotes under equal keys are searched once; they are told apart by their words, so no row needs a number.
    names = {k: f"key_{n}" for n, k in enumerate(keys)}
    asked = quotes.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()], F.col("quote").alias("words")).distinct()
    asked = asked.where(F.length(strip(fold_typography(F.col("words")))) >= SETTINGS.min_quote).withColumn("pattern", quote_pattern(F.col("words")))
    shown = chunk_rows.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()], "chunk_ix", "start", fold_typography(F.col("text")).alias("folded"))
    hits = asked.join(shown, list(names.values())).withColumn("at", F.regexp_instr("folded", F.col("pattern"))).where("at > 0")
    start = F.col("start") + F.col("at") - 1
    place = F.struct("chunk_ix", start.alias("start"), (start + F.length(F.regexp_substr("folded", F.col("pattern")))).alias("end"))
    first = hits.groupBy(*names.values(), "words").agg(F.min(place).alias("place"))
    row = quotes.select(F.struct(*[F.col(f"`{c}`") for c in quotes.columns]).alias("row"))
    same = F.col("row.quote") == F.col("words")
    for k, v in names.items():
        same &= F.col(f"row.`{k}`") == F.col(v)
    return row.join(first, same, "left").select(*[F.col(f"row.`{c}`").alias(c) for c in quotes.columns], "place.chunk_ix", "place.start", "place.end")


CHECKED = f"facts:{FACTS},quotes_asserted:int,quotes_verified:int,rejected_quotes:array<string>"
_FOLD = str.maketrans(*TYPOGRAPHIC)


_FOLDED = re.compile(f"[{''.join(map(chr, _FOLD))}]")


def _folded(text: str) -> str:
    return text.translate(_FOLD) if not text.isascii() and _FOLDED.search(text) else text


def _place(words: list[str], text: str) -> kernels.Span | None:
    """Where words first stand in a text, one after another with any white space between them."""
    if max(words, key=len) not in text:
        return None
    first, *rest = words
    start = text.find(first)
    while start >= 0:
        end = start + len(first)
        for word in rest:
            at = end
            while text[at : at + 1].isspace():
                at += 1
            if at == end or not text.startswith(word, at):
                break
            end = at + len(word)
        else:
            return start, end
        start = text.find(first, start + 1)
    return None


def _check_claims(claims: list, text: str, chunks: list) -> tuple[list, int, int, list[str]]:
    folded = _folded(text)
    shown = [(int(c["ix"]), c["start"], folded[c["start"] : c["end"]]) for c in chunks]
    facts, asserted, rejected = [], 0, []
    for entry in claims:
        claim, quote = (entry["claim"] or "").strip(), (entry["quote"] or "").strip()
        if not claim:
            continue
        sources = []
        if quote:
            asserted += 1
            words = _folded(quote).strip()
            hits = ((ix, at, place) for ix, at, part in shown if (place := _place(words.split(), part))) if len(words) >= SETTINGS.min_quote else ()
            found = next(iter(hits), None)
            if found is None:
                rejected.append(quote)
            else:
                ix, at, (a, b) = found
                a, b = at + a, at + b
                sources = [{"cited_text": text[a:b], "chunk_ix": ix, "start": a, "end": b, "support": 1.0}]
        facts.append({"text": claim, "sources": sources})
    return facts, asserted, asserted - len(rejected), rejected


def verify(claims: Column, text: Column, chunks_used: Column) -> Column:
    """A struct (facts, quotes_asserted, quotes_verified, rejected_quotes) of a reply's claims.

    A quote must occur in a chunk that the model saw; a claim whose quote does not is kept without a
    source, and the quote is listed as rejected. Each chunk is folded once for all quotes of its
    document.
    """

    bounded()
    checked = pa.struct([("facts", FACTS_ARROW), ("quotes_asserted", pa.int32()), ("quotes_verified", pa.int32()), ("rejected_quotes", pa.list_(pa.string()))])

    @F.arrow_udf(f"struct<{CHECKED}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [_check_claims(c or [], t or "", u or []) for c, t, u in zip(*[column.to_pylist() for column in batch], strict=True)]
            yield pa.array([dict(zip(checked.names, row, strict=True)) for row in rows], checked)

    return run(claims, text, chunks_used)


def citation_precision(verified: Column, asserted: Column) -> Column:
    """Share of asserted quotes that were found, of four digits; 1 if none was asserted."""
    return F.when(asserted > 0, F.round(verified / asserted, 4)).otherwise(1.0)


# ---------------------------------------------------------------- by native citations


def shift_citations(blocks: Column, text: Column, chunks_used: Column) -> Column:
    """Facts from a reply's blocks (text, citations) whose citations count from the start of a shown chunk.

    ``document_index`` is the place in the list of shown chunks, not the chunk's own number; other
    kinds of citation and places outside the list are dropped.
    """

    def source(c: Column) -> Column:
        chunk = F.get(chunks_used, c["document_index"])
        a, b = chunk["start"] + c["start_char_index"], chunk["start"] + c["end_char_index"]
        return F.struct(
            c["cited_text"].alias("cited_text"), chunk["ix"].cast("int").alias("chunk_ix"), a.cast("int").alias("start"), b.cast("int").alias("end"),
            F.lit(None).cast("double").alias("support"),
        )

    def usable(c: Column) -> Column:
        inside = (c["document_index"] >= 0) & (c["document_index"] < F.size(chunks_used))
        return (c["type"] == "char_location") & F.coalesce(inside, F.lit(False))

    cited = lambda b: F.transform(F.filter(F.coalesce(b["citations"], F.array()), usable), source)
    said = F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != "")
    return F.transform(said, lambda b: F.struct(b["text"].alias("text"), cited(b).alias("sources")))


def _shifted(blocks: list[dict | None] | None, chunks: list[dict]) -> list[dict]:
    """The same for one reply, on values of Python."""

    def source(c: dict) -> dict:
        chunk = chunks[c["document_index"]]
        a, b = (None if c.get(k) is None else chunk["start"] + c[k] for k in ("start_char_index", "end_char_index"))
        return {"cited_text": c.get("cited_text"), "chunk_ix": chunk["ix"], "start": a, "end": b, "support": None}

    def usable(c: dict | None) -> bool:
        return c is not None and c.get("type") == "char_location" and c.get("document_index") is not None and 0 <= c["document_index"] < len(chunks)

    return [{"text": b["text"], "sources": [source(c) for c in b.get("citations") or [] if usable(c)]} for b in blocks or [] if b and b.get("text")]


def aligned(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Best token containment of each claim among the sources with the same key: (key, claim_ix, containment, source_ix)."""
    from pyspark.sql import Window

    from ..functions.text import containment

    a = claims.select(key, "claim_ix", tokens(F.col("text")).alias("__c"))
    b = sources.select(key, "source_ix", tokens(F.col("text")).alias("__s"))
    pairs = a.join(b, key).select(key, "claim_ix", "source_ix", containment(F.col("__c"), F.col("__s")).alias("containment"))
    order = Window.partitionBy(key, "claim_ix").orderBy(F.col("containment").desc(), "source_ix")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SETTINGS.align_spans)
