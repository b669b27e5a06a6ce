"""Segmentation: documents into sentences, chunks and paragraphs with exact offsets.

Each step is local to a row, so nothing is shuffled; the exploded frames keep the document's
partitioning. Inputs have (doc_id, text); a null text is empty and has no segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.batches import bounded
from ..functions import kernels
from ..functions.text import citation_title, cut

SPANS = "array<struct<start:int,end:int>>"


def _spans(text: Column, kernel: Callable[[str], list[tuple[int, int]]]) -> Column:
    bounded()
    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b} for a, b in kernel(t or "")] for t in texts], dtype=object)

    return run(text)


def sentence_array(text: Column) -> Column:
    """Sentences of a text as an array of spans."""
    return _spans(text, kernels.sentence_spans)


def chunk_array(text: Column, target: int = SETTINGS.chunk_chars, overlap: int = SETTINGS.chunk_overlap) -> Column:
    """Chunks of a text as an array of spans."""
    return _spans(text, lambda t: kernels.chunk_spans(t, None, target, overlap))


def paragraph_array(text: Column) -> Column:
    return _spans(text, kernels.paragraph_spans)


def explode_spans(df: DataFrame, spans: Column, index: str) -> DataFrame:
    """(doc_id, index, start, end, text), a row for each span."""
    rows = df.select("doc_id", "text", F.posexplode(spans).alias(index, "__span"))
    start, end = F.col("__span.start"), F.col("__span.end")
    return rows.select("doc_id", index, start.alias("start"), end.alias("end"), cut(F.col("text"), start, end).alias("text"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, start, end, text)."""
    return explode_spans(docs, sentence_array(F.col("text")), "sent_ix")


def chunks(docs: DataFrame, target: int = SETTINGS.chunk_chars, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """(doc_id, chunk_ix, start, end, text, label)."""
    out = explode_spans(docs, chunk_array(F.col("text"), target, overlap), "chunk_ix")
    return out.withColumn("label", F.lit(""))


def paragraphs(docs: DataFrame) -> DataFrame:
    """The other chunker: one chunk for each run of lines without a blank one."""
    return explode_spans(docs, paragraph_array(F.col("text")), "chunk_ix").withColumn("label", F.lit(""))


def with_titles(chunk_rows: DataFrame) -> DataFrame:
    """Chunks with the title under which a model sees them."""
    return chunk_rows.withColumn("title", citation_title(F.col("label"), F.col("chunk_ix"), F.col("start"), F.col("end")))


def windows(chunk_rows: DataFrame, size: int) -> DataFrame:
    """Chunks with the number of their group of ``size`` neighbours."""
    return chunk_rows.withColumn("window_ix", F.floor(F.col("chunk_ix") / size).cast("int"))


def checked(chunk_rows: DataFrame) -> DataFrame:
    """Chunks, failing on one whose span and text differ in length."""
    wrong = F.raise_error(F.lit("a chunk's span and text differ in length"))
    good = F.when(F.col("end") - F.col("start") != F.length("text"), wrong.cast("string")).otherwise(F.col("text"))
    return chunk_rows.withColumn("text", good)


def sentences_within(sentence_rows: DataFrame, chunk_rows: DataFrame, min_chars: int = 0) -> DataFrame:
    """Sentences that lie inside a chunk, with the first such chunk as ``chunk_ix``.

    Chunks are dealt into buckets of offsets as long as the longest chunk may be, so the join is on
    equal buckets and a long document does not meet all its sentences with all its chunks.
    """
    width = F.lit(4 * SETTINGS.chunk_ceiling)
    wide = chunk_rows.select(F.col("doc_id"), "chunk_ix", F.col("start").alias("lo"), F.col("end").alias("hi")).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))
    )
    kept = sentence_rows.where(F.length("text") >= min_chars).withColumn("bucket", F.floor(F.col("start") / width))
    inside = kept.join(wide, ["doc_id", "bucket"]).where((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi")))
    keys = ["doc_id", "sent_ix", "start", "end", "text"]
    return inside.groupBy(*keys).agg(F.min("chunk_ix").alias("chunk_ix"))
