"""A training-data pipeline: five stages, each written as Parquet and read again by the next.

The toxicity stage drops documents whose calibrated score reaches the operator's threshold; line
dedup drops shared lines and keeps every document; SimHash near-dedup keeps the smallest doc_id of
each group, linked by the operator's bit budget or by a likeness of 0.8 of five-word shingles; mixing repeats or drops whole documents
so that each source meets its target; the last stage encodes what is left. Counts of characters
follow the texts.

Defined cases of every stage but the last: the columns are those of its input; null and empty texts
are clean, have one empty line (line dedup turns a null text into an empty one), link with each
other, and are kept once by the mix; rows without a doc_id or a source are kept like others, but
near-dedup keeps those without a doc_id only if no row of their group has one, and one row of
each repeated doc_id; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, common, line_dedup, mixing, simhash_dedup, toxicity


def _documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as long as the text now is."""
    length = F.length("text").cast("long")
    return df.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator accepts."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    score = common.fresh(docs, "__toxicity")[0]
    kept = toxicity.score_documents(docs, labels).where(F.col(score) < toxicity.REJECT)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share."""
    return _documents(line_dedup.dedup_lines(docs), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, XXH64 fingerprints and merges have no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every intermediate table lies in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
