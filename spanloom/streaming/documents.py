"""An extension beyond the batch engine: row-local steps and windowed counts on streams of documents.

Segmentation, number checks and text functions see one row at a time, so they run unchanged on a
streaming frame; what aggregates needs a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.segment import chunk_array, sentence_array


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, ts timestamp") -> DataFrame:
    """New Parquet files under a path."""
    return spark.readStream.schema(schema).parquet(path)


def segmented(docs: DataFrame) -> DataFrame:
    """A stream of documents with their sentences, chunks and token count."""
    text = F.col("text")
    return docs.withColumns({"sentences": sentence_array(text), "chunks": chunk_array(text), "n_tokens": F.size(tokens(text))})


def counts_by_window(docs: DataFrame, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """(start, n_docs, n_sentences, n_tokens) by event time; rows later than the watermark are left out."""
    rows = segmented(docs.withWatermark("ts", late))
    grouped = rows.groupBy(F.window("ts", window).alias("w"))
    counts = grouped.agg(F.count("*").alias("n_docs"), F.sum(F.size("sentences")).alias("n_sentences"), F.sum("n_tokens").alias("n_tokens"))
    return counts.select(F.col("w.start").alias("start"), "n_docs", "n_sentences", "n_tokens")
