"""Chat formatting: conversations rendered by a compiled template, with the spans a loss is taken on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chat_template import Template, unescape

#: The default format. Its control strings all contain # or <, which are escaped inside texts.
TURNS = (
    "{%- for turn in messages -%}"
    "### {{ turn.role | escape('#<:') }}: "
    "{%- if turn.role == 'assistant' %}{{ ' ' }}{% generation %}{{ turn.text | escape('#<') }}{% endgeneration %}"
    "{%- else %}{{ ' ' }}{{ turn.text | escape('#<') }}{% endif -%}"
    "</turn>{{ '\\n' }}"
    "{%- endfor -%}"
)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*+): ((?:[^\\#<]|\\.)*+)</turn>\n", re.DOTALL)
_FORMATTED = "conv_id {}, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


@lru_cache(maxsize=8)
def compiled(source: str) -> Template:
    """A template is parsed and compiled once in a process."""
    return Template(source)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text in the default format; an error if it is not in that format."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def _render(source: str, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compiled(source)
        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True))
        held: list[tuple] = []
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            messages = [{"turn": turn, "role": role or "", "text": text or ""} for _, turn, role, text in turns]
            text, spans = template.render(messages=messages)
            held.append((conv, len(messages), text, [{"start": a, "end": b} for a, b in spans]))
            if len(held) >= common.ARROW_ROWS or len(text) > 1 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)

    return run


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """One row (conv_id, n_turns, formatted, loss) for each conversation.

    The template sees ``messages``, each with turn, role and text, ordered by turn. Rows are dealt
    by conversation and sorted on disk; a task then streams through them and holds one conversation
    and its output at a time, which is the row it returns. Defined cases: null role and text are empty; a
    null turn comes first; equal turns are ordered by role, then text; repeated rows repeat; rows
    without conv_id form one conversation; no rows, no result; other columns are not read.
    """
    common.small_batches(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    number = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", number), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_render(template, schema), _FORMATTED.format(kind))


def digests(formatted: Column, loss: Column) -> Column:
    """Digests of the turns and of the text under the loss mask, read back from the output."""

    @F.pandas_udf("turns_sha256 string, loss_chars long, loss_sha256 string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            out = []
            for text, mask in zip(texts, masks, strict=True):
                turns, under, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, content in read_back(text):
                    turns.update(f"{role}\n{content}\n".encode())
                for span in mask if mask is not None else ():
                    part = unescape(text[span["start"] : span["end"]])
                    chars += len(part)
                    under.update(part.encode())
                out.append((turns.hexdigest(), chars, under.hexdigest()))
            yield pd.DataFrame(out, columns=["turns_sha256", "loss_chars", "loss_sha256"])

    return read(formatted, loss)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`format_conversations` over all conversations and conversation -7."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    out = format_conversations(turns.unionByName(extra)).withColumn("d", digests(F.col("formatted"), F.col("loss")))
    return out.select("conv_id", "n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'),
                                  (-7::BIGINT, 1::BIGINT, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn ASC NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn ASC NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + 2 * length(role) - length(translate(role, '\#<:', '')) + 2 * length(text) - length(translate(text, '\#<', '')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
