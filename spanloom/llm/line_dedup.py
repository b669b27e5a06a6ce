"""Line dedup: explode normalised lines, hash them, count documents per hash, drop, reassemble."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract.
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    """Strip the six ASCII white-space bytes at both ends and lower-case A-Z; other bytes stay."""
    return line.strip().lower()


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def line_hashes(text: Column, min_chars: int) -> Column:
    """The distinct 128-bit hashes of a text's long line keys."""

    @F.pandas_udf("array<binary>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                keys = map(line_key, (t or "").encode().split(b"\n"))
                out.append(list({_hash(k) for k in keys if _long_enough(k, min_chars)}))
            yield pd.Series(out, dtype=object)

    return hashes(text)


def _without(text: Column, dropped: Column, min_chars: int) -> Column:
    """Rebuild a text from the lines whose hash is not in ``dropped``."""

    @F.pandas_udf("n_lines long, n_dropped long, text string")
    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in batches:
            rows = []
            for t, d in zip(texts, drops, strict=True):
                lines = (t or "").encode().split(b"\n")
                gone = set() if d is None else {bytes(x) for x in d}
                kept = lines
                if gone:
                    kept = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in gone)]
                rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])

    return rebuild(text, dropped)


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes held by at least ``min_docs`` documents, with the largest doc_id that holds each.

    ``lines`` has a row (doc_id, h) for each document and hash. The rows are first made distinct by
    both columns, which spreads a line that a third of the documents share over all partitions; the
    count by hash then starts with map-side partial sums.
    """
    return (
        lines.where("doc_id is not null")
        .select("h", "doc_id").distinct()
        .groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop frequent long lines from all documents but the one with the largest doc_id that holds them.

    Returns every input row with ``text`` rebuilt, plus ``__n_lines`` (before dropping) and
    ``__n_dropped``. Defined cases: a null or empty text is one empty line and becomes ''; a row
    whose doc_id is null is neither counted nor changed; rows that share a doc_id count as one
    document and lose the same lines; a document whose lines all go keeps an empty text; an empty
    table stays empty; other columns, whatever their names, pass through, and where one already has
    the name of a new column, the new one gets underscores behind it.
    """
    common.small_batches(docs.sparkSession)
    lines = common.materialise(
        docs.select("doc_id", F.explode(line_hashes(F.col("text"), min_chars)).alias("h")), "lines"
    )
    frequent = common.materialise(frequent_lines(lines, min_docs), "frequent-lines")
    dropped = (
        lines.join(common.bounded_broadcast(frequent, frequent.count()), "h")
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("gone_id"))
        .agg(F.collect_set("h").alias("gone"))
    )
    # The caller's row travels in one column, so that no name of it meets a name from here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(dropped, F.col("row.doc_id") == F.col("gone_id"), "left")
    out = out.select("row", _without(F.col("row.text"), F.col("gone"), min_chars).alias("kept"))
    n_lines, n_dropped = common.fresh(docs, "__n_lines", "__n_dropped")
    return out.select(
        *[F.col("kept.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.col("kept.n_lines").alias(n_lines),
        F.col("kept.n_dropped").alias(n_dropped),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`dedup_lines` over all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


#: DuckDB's lower() also folds letters beyond A-Z, hence translate().
OP6_SQL = """
WITH lines AS (
  SELECT doc_id, i, l,
         translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
gone AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT lines.*, gone.k IS NOT NULL AND doc_id <> keeper AS lost FROM lines LEFT JOIN gone USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
