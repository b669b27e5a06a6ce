"""Validation of automatic metrics against human scores: rank correlation, discrimination, blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS


def average_rank(value: str, *keys: str) -> Column:
    """Rank with ties at their mean, within the keys."""
    by, same = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return F.rank().over(by) + (F.count("*").over(same) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's r; null where a side does not vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread))


#: A value that at least one in so many rows has is common; there are no more common values than this.
COMMON_SHARE = 1000


def average_ranks(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, one rank column for each) with average ranks over the whole table, without a one-task window.

    Values are counted first; the running count is taken over distinct values, in ranges that are
    offset by the totals of the ranges before them, so no window sees the whole table. Common values,
    a bounded number, meet the rows by broadcast; the rest by a join that no value dominates, in which rows
    that need no partner are dealt out by their key.
    """
    out = rows.select(key, *columns)
    total = rows.count()
    for c in columns:
        ranked = prefix_counts(rows.groupBy(c).agg(F.count("*").alias("__n")), c)
        ranked = ranked.select("__value", (F.col("__before") + (F.col("__n") + 1) / 2).alias("__rank"), (F.col("__n") * COMMON_SHARE >= total).alias("__common"))
        often = ranked.where("__common").select(F.col("__value").alias("__often"), F.col("__rank").alias("__often_rank"))
        seldom = ranked.where("not __common").select(F.col("__value").alias("__seldom"), F.col("__rank").alias("__seldom_rank"), F.lit(0).alias("__none"))
        out = out.join(F.broadcast(often), F.col(c) == F.col("__often"), "left")
        done = F.col("__often_rank").isNotNull() | F.col(c).isNull()
        out = out.withColumn("__want", F.when(~done, F.col(c))).withColumn("__deal", F.when(done, F.pmod(F.xxhash64(key), F.lit(1 << 20))).otherwise(0))
        out = out.join(seldom, (F.col("__want") == F.col("__seldom")) & (F.col("__deal") == F.col("__none")), "left")
        out = out.withColumn(f"rank_{c}", F.coalesce("__often_rank", "__seldom_rank")).drop("__often", "__often_rank", "__want", "__deal", "__seldom", "__seldom_rank", "__none")
    return out


def prefix_counts(counts: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """(__value, __n, __before): for each distinct value the rows with smaller ones."""
    counts = counts.where(F.col(value).isNotNull())
    limits = counts.agg(F.percentile_approx(value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10 * buckets)).alias("b")).first()["b"]
    edges = F.lit(sorted(set(limits))) if limits else F.array().cast("array<double>")
    dealt = counts.withColumn("__b", F.size(F.filter(edges, lambda e: e <= F.col(value))))
    sums = dealt.groupBy("__b").agg(F.sum("__n").alias("__s"))
    order = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__b").alias("__k"), F.coalesce(F.sum("__s").over(order), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__i", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    dealt = dealt.join(F.broadcast(sums), F.col("__b") == F.col("__k"))  # at most one row a bucket
    return dealt.select(F.col(value).alias("__value"), "__n", (F.col("__i") + F.col("__o")).alias("__before"))


def correlations(rows: DataFrame, automatic: list[str], human: list[str], key: str) -> list[dict]:
    """Spearman's rho of every pair of metrics, with its two-sided p-value."""
    ranks = average_ranks(rows, [*automatic, *human], key)
    pairs = [(a, h) for a in automatic for h in human]
    got = ranks.agg(F.count("*").alias("n"), *[correlation(f"rank_{a}", f"rank_{h}").alias(f"{a}|{h}") for a, h in pairs]).first()
    return [{"metric": a, "human": h, "rho": got[f"{a}|{h}"], "p": p_value(got[f"{a}|{h}"], got["n"])} for a, h in pairs]


def p_value(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation, by Student's t with n - 2 degrees of freedom."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    return _beta_share(df / 2, 0.5, 1 - rho * rho)


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return max(0.0, min(1.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d if abs(1 + step * d) > tiny else tiny)
        c = 1 + step / c if abs(1 + step / c) > tiny else tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def label_discrimination(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(label, mean, sd, min, max, zero_share) of each column; sd of the population."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = rows.selectExpr(f"stack({len(columns)}, {parts}) as (label, value)").where("value is not null")
    return long.groupBy("label").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg((F.col("value") == 0).cast("int")).alias("zero_share"),
    )


def block_means(rows: DataFrame, position: str, columns: list[str], size: int = SETTINGS.block_rows) -> DataFrame:
    """(block, n, a mean for each column) over blocks of rows by position."""
    block = F.floor(F.col(position) / size).cast("long").alias("block")
    return rows.groupBy(block).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


#: The automatic and the human metrics that are compared.
AUTOMATIC = ["grounding_coverage", "mean_support", "numeric_fidelity", "rouge1", "rougeL"]
HUMAN = ["FactualF1", "FactualPrecision", "FactualRecall", "HallucinationRate", "OmissionRate"]


def validation_rows(pairs: DataFrame, source: str = "Dialogue", summary: str = "Automatic Summary", reference: str = "Reference Summary", embedder=None) -> DataFrame:
    """(pos, five automatic and five human metrics) of positional pairs; nothing is shuffled.

    Grounding coverage is the share of the summary's sentences with a supporting source sentence, mean
    support the mean over all spans kept; both are 0 where a side has no sentences.
    """
    from . import metrics
    from .ground import ground
    from .segment import chunk_array

    text, said = F.col(f"`{source}`"), F.col(f"`{summary}`")
    chunks = F.transform("__c", lambda c, k: F.struct(k.alias("ix"), c["start"].alias("start"), c["end"].alias("end")))
    df = pairs.withColumn("__c", chunk_array(text)).withColumn("__u", chunks)
    df = df.withColumn("__f", ground(said, text, F.col("__u"), embedder, min_chars=0))
    supports = F.transform(metrics.all_spans(F.col("__f")), lambda s: s["support"])
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    values = {
        "grounding_coverage": share(F.size(F.filter("__f", lambda f: F.size(f["sources"]) > 0)), F.size("__f")),
        "mean_support": share(F.aggregate(supports, F.lit(0.0), lambda s, x: s + x), F.size(supports)),
        "numeric_fidelity": metrics.numeric_fidelity(said, text),
        "rouge1": metrics.rouge_n_column(said, F.col(f"`{reference}`"), 1)["f1"],
        "rougeL": metrics.rouge_l(said, F.col(f"`{reference}`"))["f1"],
    }
    return df.select("pos", *[v.alias(n) for n, v in values.items()], *[F.col(h).cast("double") for h in HUMAN])
