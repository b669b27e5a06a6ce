"""Mixing sources to target weights: hash-random keys, range buckets, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: weights by rank of the source, share of all sizes, most repeats.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows that a bucket of a source's key range is meant to hold, and the most buckets of a source.
BUCKET_ROWS, MAX_BUCKETS = 256, 65_536


def n_words(text: str = "text"):
    """Number of runs of characters other than the six ASCII white-space ones; 0 for null."""
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(common.SPACE_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, common.SPACE + "+"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sources from (source, source_size, n): ``share`` of all sizes by weight, at most ``most`` times a size.

    Resharing the excess by weight until nobody is above its limit has the closed form
    min(limit, x * weight): x is found from the sources in order of limit / weight. The windows here
    run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    every, order = Window.partitionBy(), Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    x = (F.sum("source_size").over(every) * F.lit(float(share)) - before) / left
    ranked = ranked.withColumn("x", x)
    level = F.coalesce(F.max(F.when(F.col("x") <= F.col("ratio"), F.col("x"))).over(every), F.lit(0.0))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("w")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, source, size).

    Within a source rows are ordered by a random key made from the seed and doc_id. The key range of
    a source is dealt into buckets in proportion to its rows, so a source with a third of all rows
    spreads over as many tasks as it needs; prefix sums run inside buckets, and sums of whole buckets
    give each bucket's offset. A source's target is filled with whole epochs, then with the rows
    before the cut; the row at the cut gives only the words that still fit, so a source's taken words
    are exactly its rounded target. Defined cases: null source is a source, the last; size 0 takes 0;
    a null doc_id has the key of the word null; equal rows are interchangeable; empty input, no rows.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10)
    base = common.materialise(docs.select("doc_id", "source", "size", key.cast("long").alias("key")), "mix-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(totals, weights, share, most)
    budget = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / size)
    targets = common.materialise(
        targets.select(
            F.col("source").alias("__source"), "rank", "source_size", "target",
            epochs.alias("epochs"), (budget - epochs * size).alias("rest"),
            F.least(F.lit(MAX_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))).cast("long").alias("buckets"),
        ),
        "mix-targets",
    )
    rows = base.join(common.bounded_broadcast(targets, targets.count()), F.col("source").eqNullSafe(F.col("__source")))
    bucket = F.shiftright(F.shiftright("key", 28) * F.col("buckets"), 32).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("s"))
    along = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["rank", "bucket"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("before")))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken")
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, all columns kept.

    A text is repeated only whole: a row at the cut is in if at least half of it fits. Rows of size 0
    carry no words and are kept once, so that no clean row is lost. Defined cases: a null text has size
    0; rows that share a doc_id and a source, null included, are counted as one document with the sum
    of their sizes; an empty table stays empty; other columns, whatever their names, pass through.
    """
    # The caller's row travels in one column, so that no name of it meets a name from here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = docs.select("doc_id", "source", n_words().alias("size"))
    one = sized.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    taken = mix(one, **how).select(
        F.col("doc_id").alias("id"), F.col("source").alias("of"),
        F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("times"),
    )
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("of"))
    out = rows.join(taken, same).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`mix` over all documents."""
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", n_words().alias("size"))).drop("source")


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
weighed AS (
  SELECT *, 2 * source_size AS cap, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1]::DOUBLE AS w FROM ranked),
levels AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER ()::DOUBLE * 1.5
          - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce(max(x) FILTER (x <= ratio) OVER (), 0) * w) AS target FROM levels),
cuts AS (
  SELECT *, floor(round(target) / greatest(source_size, 1))::BIGINT AS epochs,
         round(target)::BIGINT - floor(round(target) / greatest(source_size, 1))::BIGINT * greatest(source_size, 1) AS rest
  FROM targets)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (
          PARTITION BY base.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM base JOIN cuts ON base.source IS NOT DISTINCT FROM cuts.source
"""
