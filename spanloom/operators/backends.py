"""Summary backends: one result shape, five ways in which a citation earns belief.

A generator is any picklable object with ``complete(prompt) -> dict``. Prompts are built in Spark,
completions are fetched by partition in Python, and grounding happens in Spark again. Errors are
values in the ``error`` column: a document that fails never fails its task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT_LENGTH, LENGTH_SENTENCES, SETTINGS, aspect_queries
from ..functions import kernels
from ..functions.batches import bounded
from ..functions.text import cut, strip_artifacts
from .embedders import Embedder
from .ground import citation_precision, ground, parse_claims, shift_citations, verify
from .summarise import FACTS, select_chunks, summarise_extractive
from .transport import ChatClient, GenerationError, LocalModel, Pacer, QuotaExhausted, Truncated, parse_wait, required_key  # noqa: F401

REPLY = "content string, blocks array<struct<text:string,citations:array<struct<type:string,cited_text:string,document_index:int,start_char_index:int,end_char_index:int>>>>, stop_reason string, model string, input_tokens long, output_tokens long, error string"
_CITATION = pa.struct([("type", pa.string()), ("cited_text", pa.string()), ("document_index", pa.int32()), ("start_char_index", pa.int32()), ("end_char_index", pa.int32())])
REPLY_ARROW = pa.struct([
    ("content", pa.string()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("citations", pa.list_(_CITATION))]))), ("stop_reason", pa.string()),
    ("model", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string()),
])
LENGTH_NOTES = {
    "brief": "Keep to the three or four facts that matter most.",
    "standard": "Write a short paragraph of the main facts.",
    "full": "Cover every distinct fact of the excerpts.",
}
TASK = "Summarise the excerpts. State only what they say, one claim in a sentence, and keep numbers as written."
CLAIM_TASK = (
    'Answer with a JSON object {"claims": [{"claim": ..., "quote": ...}]}. Each claim is one statement; '
    "its quote is copied word for word from the excerpts."
)


class Generator(Protocol):
    """``prompt`` has task, excerpts (a list of texts), documents (JSON of citable blocks, or null), json and max_tokens.

    The reply has the fields of REPLY, missing ones null.
    """

    def complete(self, prompt: dict) -> dict: ...


# ---------------------------------------------------------------- stand-ins


@dataclass
class EchoGenerator:
    """Deterministic stand-in: the first sentences of the first excerpts, and one claim that is invented."""

    sentences: int = 3
    invent: bool = True
    invented: str = "The committee approved 731 spacecraft on the moon."
    #: The last list of excerpts and its sentences: backends that are compared ask with one list.
    last: tuple = field(default=(None, ()), init=False, repr=False, compare=False)

    def _said(self, excerpts: list[str]) -> list[tuple[int, int, int, str]]:
        if self.last[0] is not excerpts:
            said = []
            for k, text in enumerate(excerpts):
                if len(said) >= self.sentences:
                    break
                said += [(k, a, b, text[a:b]) for a, b in kernels.sentence_spans(text)]
            self.last = excerpts, said[: self.sentences]
        return self.last[1]

    def complete(self, prompt: dict) -> dict:
        said = self._said(prompt["excerpts"])
        cite = lambda k, a, b, t: {"type": "char_location", "cited_text": t, "document_index": k, "start_char_index": a, "end_char_index": b}
        blocks = [{"text": t, "citations": [cite(k, a, b, t)]} for k, a, b, t in said]
        claims = [{"claim": t, "quote": t} for *_, t in said]
        if self.invent:
            claims.append({"claim": self.invented, "quote": self.invented})
        prose = " ".join([t for *_, t in said] + [self.invented] * self.invent)
        content = json.dumps({"claims": claims}, ensure_ascii=False) if prompt["json"] else prose
        return {"content": content, "blocks": blocks, "stop_reason": "end_turn", "model": "echo", "input_tokens": 0, "output_tokens": 0}


@dataclass
class RefusingGenerator:
    """Stand-in that declines every request."""

    reason: str = "declined"

    def complete(self, prompt: dict) -> dict:
        return {"content": self.reason, "stop_reason": "refusal"}


# ---------------------------------------------------------------- generation on Spark


def _replies(rows: list[dict]) -> pa.Array:
    """Replies as REPLY has them, missing fields null; one of other types is an error of its document."""
    try:
        return pa.array(rows, REPLY_ARROW)
    except (pa.ArrowException, TypeError, ValueError) as e:
        if len(rows) == 1:
            return pa.array([{"error": f"{type(e).__name__}: {e}"}], REPLY_ARROW)
        return pa.concat_arrays([_replies([row]) for row in rows])


_SURROGATE = re.compile("[\ud800-\udfff]")


def _is_plain(row: dict) -> bool:
    """Whether a reply is certain to come back from an Arrow array as it is, but for missing fields."""
    texts, short, long = [row.get(n) for n in ("content", "stop_reason", "model", "error")], [], [row.get(n) for n in ("input_tokens", "output_tokens")]
    blocks = row.get("blocks")
    if blocks is not None:
        if type(blocks) is not list:
            return False
        for block in blocks:
            if type(block) is not dict or type(block.get("citations", [])) is not list:
                return False
            texts.append(block.get("text"))
            for c in block.get("citations", []):
                if type(c) is not dict:
                    return False
                texts += c.get("type"), c.get("cited_text")
                short += c.get("document_index"), c.get("start_char_index"), c.get("end_char_index")
    none = type(None)
    if not set(map(type, texts)) <= {str, none} or not set(map(type, short + long)) <= {int, none}:
        return False
    if not all(n is None or -(1 << 31) <= n < 1 << 31 for n in short) or not all(n is None or -(1 << 63) <= n < 1 << 63 for n in long):
        return False
    return not any(t and not t.isascii() and _SURROGATE.search(t) for t in texts)


def checked_reply(row: dict) -> dict:
    """The same for one reply, on values of Python."""
    if type(row) is dict and _is_plain(row):
        return row
    return _replies([row]).to_pylist()[0]


@dataclass
class Request:
    """What one backend asks of its generator for each document."""

    generator: Generator
    task: str
    json: bool
    max_tokens: int

    def reply(self, texts: list[str] | None, blocks: str | None) -> dict:
        """The reply, or its error; a document without texts is not asked for."""
        if not texts:
            return {}
        try:
            return self.generator.complete({"task": self.task, "excerpts": texts, "documents": blocks, "json": self.json, "max_tokens": self.max_tokens})
        except Exception as e:  # noqa: BLE001  a failed document is a row, not a failed task
            return {"error": f"{type(e).__name__}: {e}"}


def request(backend: str, generator: Generator | None, tasks: int, length: str | None = None, instruction: str | None = None) -> Request:
    """The request of a backend that generates, for one of so many tasks."""
    limits = {"api": SETTINGS.api_tokens, "local": SETTINGS.local_tokens, "remote": SETTINGS.remote_tokens, "verified": SETTINGS.verified_tokens}
    if backend not in limits:
        raise ValueError(f"no backend {backend!r}; there are extractive, {', '.join(limits)}")
    if generator is None:
        raise ValueError(f"the {backend} backend needs a generator")
    verified = backend == "verified"
    task = f"{instruction or TASK} {CLAIM_TASK}" if verified else task_text(length, instruction, TASK)
    if isinstance(generator, ChatClient):
        generator = generator.shared(tasks)
    return Request(generator, task, verified, limits[backend])


def _complete(excerpts: Column, documents: Column, asked: Request) -> Column:
    """The replies to prompts over (texts, blocks)."""
    bounded()

    @F.arrow_udf(StructType.fromDDL(REPLY))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _replies([asked.reply(*row) for row in zip(*[column.to_pylist() for column in batch], strict=True)])

    return run(excerpts, documents)


def task_text(length: str | None, instruction: str | None, base: str) -> str:
    name = length or DEFAULT_LENGTH
    if name not in LENGTH_SENTENCES:
        raise ValueError(f"length is one of {sorted(LENGTH_SENTENCES)}, not {name!r}")
    return f"{instruction or base} {LENGTH_NOTES[name]}"


def summarise(
    docs: DataFrame, backend: str, generator: Generator | None = None, aspects: str | list[str] = "generic", top_k: int = SETTINGS.top_k,
    chunk_budget: int | None = None, length: str | None = None, instruction: str | None = None, embedder: Embedder | None = None,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, text, summary, facts, chunks_used, stop_reason, refusal, usage, error) by one of the five backends.

    ``chosen`` may be what :func:`select_chunks` has made of the same documents, so that backends share it.
    """
    usage_type = "struct<model:string,input_tokens:bigint,output_tokens:bigint,quotes_asserted:int,quotes_verified:int,citation_precision:double,rejected_quotes:array<string>>"
    if backend == "extractive":
        out = summarise_extractive(docs, aspects, top_k, chunk_budget, None, length, embedder, chosen)
        none = F.lit(None).cast("string")
        return out.withColumns({"refusal": none, "usage": F.lit(None).cast(usage_type), "error": none})
    asked = request(backend, generator, docs.sparkSession.sparkContext.defaultParallelism, length, instruction)
    if chosen is None:
        chosen = select_chunks(docs.select("doc_id", "text"), aspect_queries(aspects), top_k, chunk_budget, embedder)
    excerpts = F.transform("chunks_used", lambda c: cut(F.col("text"), c["start"], c["end"]))
    verified = backend == "verified"
    blocks = document_blocks(F.col("text"), F.col("chunks_used")) if backend == "api" else F.lit(None).cast("string")
    df = chosen.withColumn("__r", _complete(excerpts, blocks, asked))
    refused = F.col("__r.stop_reason") == "refusal"
    content, blank = F.coalesce(F.col("__r.content"), F.lit("")), F.from_json(F.lit("[]"), FACTS)
    checked = None
    if verified:
        df = df.withColumn("__v", verify(parse_claims(content), F.col("text"), F.col("chunks_used")))
        checked = F.col("__v")
        facts, join = checked["facts"], " "
    elif backend == "api":
        facts, join = shift_citations(F.coalesce("__r.blocks", F.array().cast(dict(df.select("__r.blocks").dtypes)["blocks"])), F.col("text"), F.col("chunks_used")), ""
    else:
        facts, join = ground(strip_artifacts(content), F.col("text"), F.col("chunks_used"), embedder), " "
    df = df.withColumn("facts", F.when(refused | F.col("__r.error").isNotNull(), blank).otherwise(facts).cast(FACTS))
    summary = F.array_join(F.transform("facts", lambda f: f["text"]), join)
    if backend in ("local", "remote"):
        summary = F.when(refused, "").otherwise(strip_artifacts(content))
    null_int = F.lit(None).cast("int")
    counts = [checked["quotes_asserted"], checked["quotes_verified"]] if verified else [null_int, null_int]
    precision = citation_precision(*counts[::-1]) if verified else F.lit(None).cast("double")
    usage = F.struct(
        F.col("__r.model").alias("model"), F.col("__r.input_tokens").alias("input_tokens"), F.col("__r.output_tokens").alias("output_tokens"),
        counts[0].alias("quotes_asserted"), counts[1].alias("quotes_verified"), precision.alias("citation_precision"),
        (checked["rejected_quotes"] if verified else F.lit(None).cast("array<string>")).alias("rejected_quotes"),
    )
    return df.select(
        "doc_id", "text", summary.alias("summary"), "facts", "chunks_used", F.col("__r.stop_reason").alias("stop_reason"),
        F.when(refused, content).alias("refusal"), usage.cast(usage_type).alias("usage"), F.col("__r.error").alias("error"),
    )


def document_blocks(text: Column, chunks_used: Column) -> Column:
    """The api request's JSON: one citable document for each chunk, titled by its place, in context of its neighbours' number."""
    block = lambda c: F.struct(
        F.lit("document").alias("type"),
        F.struct(F.lit("text").alias("type"), F.lit("text/plain").alias("media_type"), cut(text, c["start"], c["end"]).alias("data")).alias("source"),
        F.format_string("[%d] chars %d-%d", c["ix"], c["start"], c["end"]).alias("title"),
        F.format_string("Excerpt %d of the document, characters %d to %d.", c["ix"] + 1, c["start"], c["end"]).alias("context"),
        F.struct(F.lit(True).alias("enabled")).alias("citations"),
    )
    return F.to_json(F.transform(chunks_used, block))


def block_json(text: str, chunks: list[dict]) -> str:
    """The same for one text, on values of Python."""
    return json.dumps([
        {
            "type": "document", "source": {"type": "text", "media_type": "text/plain", "data": text[c["start"] : c["end"]]},
            "title": f"[{c['ix']}] chars {c['start']}-{c['end']}",
            "context": f"Excerpt {c['ix'] + 1} of the document, characters {c['start']} to {c['end']}.", "citations": {"enabled": True},
        }
        for c in chunks
    ], ensure_ascii=False, separators=(",", ":"))
