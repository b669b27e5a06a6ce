"""Scores of summaries: overlap with a reference, attribution, integrity of citations, faithful numbers.

All are expressions inside a row except the LCS, which is an Arrow-batched kernel; only means over
documents aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain
from ..functions.batches import bounded
from ..functions.kernels import lcs_length
from ..functions.text import cut, is_claim_like, let, numbers, numeric_forms, squeeze, strip, tokens
from ..functions.text import containment  # noqa: F401  (part of this module's interface)


def f1(overlap: Column, predicted: Column, reference: Column) -> Column:
    """A struct (precision, recall, f1), 0 where a side is empty."""
    p = F.when(predicted > 0, overlap / predicted).otherwise(0.0)
    r = F.when(reference > 0, overlap / reference).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def ngrams(toks: Column, n: int) -> Column:
    """N-grams as strings; none for a list shorter than n."""
    if n == 1:
        return F.coalesce(toks, F.array().cast("array<string>"))

    def grams(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    return F.coalesce(let(toks, grams), F.array().cast("array<string>"))


def rouge_n(rows: DataFrame, key: str, prediction: str, reference: str, n: int = 1) -> DataFrame:
    """(key, precision, recall, f1) by clipped n-gram counts; ``key`` is unique in ``rows``.

    N-grams of both sides are counted by key and gram in one pass: a gram adds the lesser of its two
    counts. Partial counts are made before the shuffle, and keys without grams keep their row.
    """
    a, b = ngrams(tokens(F.col(prediction)), n), ngrams(tokens(F.col(reference)), n)
    sides = F.array(F.struct(F.lit(0).alias("side"), a.alias("grams")), F.struct(F.lit(1).alias("side"), b.alias("grams")))
    grams = rows.select(key, F.explode(sides).alias("s")).select(key, "s.side", F.explode_outer("s.grams").alias("gram"))
    has = F.col("gram").isNotNull()
    counts = grams.groupBy(key, "gram").agg(F.sum(F.when(has & (F.col("side") == 0), 1).otherwise(0)).alias("p"), F.sum(F.when(has & (F.col("side") == 1), 1).otherwise(0)).alias("r"))
    sums = counts.groupBy(key).agg(F.sum(F.least("p", "r")).alias("o"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    return sums.select(key, f1(F.col("o"), F.col("p"), F.col("r")).alias("s")).select(key, "s.*")


def rouge_n_column(prediction: Column, reference: Column, n: int = 1) -> Column:
    """The same inside a row, for summaries of ordinary length: distinct grams meet the other side's counts."""
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))

    def both(g: Column) -> Column:
        a, b = g["a"], g["b"]
        shared = F.transform(F.array_intersect(a, b), lambda x: F.least(count(a, x), count(b, x)))
        return f1(F.aggregate(shared, F.lit(0), lambda s, x: s + x), F.size(a), F.size(b))

    return let(F.struct(ngrams(tokens(prediction), n).alias("a"), ngrams(tokens(reference), n).alias("b")), both)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays."""

    bounded()
    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([0 if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="int32")

    return run(a, b)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """A struct (precision, recall, f1) by the longest common subsequence."""
    a, b = tokens(prediction), tokens(reference)
    return f1(lcs(a, b), F.size(a), F.size(b))


def coverage(facts: Column) -> Column:
    """Share of the facts' characters, white space at the ends aside, that belong to facts with a source."""
    size = lambda f: F.length(strip(f["text"]))
    add = lambda s, x: s + x
    total = F.aggregate(F.transform(facts, size), F.lit(0), add)
    cited = F.aggregate(F.transform(F.filter(facts, lambda f: F.size(f["sources"]) > 0), size), F.lit(0), add)
    return F.when(total > 0, cited / total).otherwise(0.0)


def all_spans(facts: Column) -> Column:
    return F.flatten(F.transform(facts, lambda f: f["sources"]))


def invalid_citations(facts: Column, text: Column) -> Column:
    """Spans out of bounds, or whose slice of the source is not what was cited, white space aside."""

    def wrong(s: Column) -> Column:
        inside = (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length(text))
        return ~inside | (squeeze(cut(text, s["start"], s["end"])) != squeeze(s["cited_text"]))

    return F.size(F.filter(all_spans(facts), wrong))


def citation_integrity(facts: Column, text: Column) -> Column:
    """Share of spans that hold; 1 without spans."""
    n = F.size(all_spans(facts))
    return F.when(n > 0, (n - invalid_citations(facts, text)) / n).otherwise(1.0)


def unsupported_numbers(summary: Column, source: Column) -> Column:
    """Numbers of the summary, repeats included, none of whose forms the source has."""
    supported = F.array_distinct(F.flatten(F.transform(numbers(source), numeric_forms)))
    return let(supported, lambda s: F.filter(numbers(summary), lambda n: ~F.arrays_overlap(numeric_forms(n), s)))


def numeric_fidelity(summary: Column, source: Column) -> Column:
    """Share of the summary's numbers that the source supports; 1 without numbers."""
    n = F.size(numbers(summary))
    return F.when(n > 0, (n - F.size(unsupported_numbers(summary, source))) / n).otherwise(1.0)


SCORES = (
    "rouge1_f1", "rouge2_f1", "rougeL_f1", "attribution_coverage", "citation_integrity", "numeric_fidelity", "invalid_citations", "n_claims", "n_spans",
)


def _is_invalid(s: dict, text: str) -> bool:
    a, b = s["start"], s["end"]
    if (a is not None and a < 0) or (b is not None and b > len(text)) or (None not in (a, b) and a > b):
        return True
    if None in (a, b, s["cited_text"]):
        return False
    return text[a:b] != s["cited_text"] and plain.squeeze(text[a:b]) != plain.squeeze(s["cited_text"])


#: Scores of facts without a reference: not rounded, on values of Python.
FACT_SCORES = "attribution_coverage double, citation_integrity double, numeric_fidelity double, invalid_citations int, n_claims int, n_spans int"


def source_forms(text: str) -> set[str]:
    """All forms of a source's numbers."""
    return {form for n in set(plain.numbers(text)) for form in plain.numeric_forms(n)}


def fact_scores(summary: str, facts: list[dict], text: str, supported: set[str]) -> dict:
    """FACT_SCORES of one summary, as the columns above give them; ``supported`` are the forms of its source's numbers."""
    sizes = [len(plain.strip(f["text"])) for f in facts]
    total, cited = sum(sizes), sum(n for n, f in zip(sizes, facts, strict=True) if f["sources"])
    spans = [s for f in facts for s in f["sources"]]
    wrong = sum(_is_invalid(s, text) for s in spans)
    said = plain.numbers(summary)
    missing = sum(supported.isdisjoint(plain.numeric_forms(n)) for n in said)
    return {
        "attribution_coverage": cited / total if total else 0.0, "citation_integrity": (len(spans) - wrong) / len(spans) if spans else 1.0,
        "numeric_fidelity": (len(said) - missing) / len(said) if said else 1.0, "invalid_citations": wrong,
        "n_claims": sum(plain.is_claim_like(f["text"]) for f in facts), "n_spans": len(spans),
    }


def rouge_scores(summary: Column, reference: Column | None) -> list[Column]:
    """ROUGE-1, 2 and L against a reference; 0 without one."""
    if reference is None:
        return [F.lit(0.0)] * 3
    has = F.coalesce(reference, F.lit("")) != ""
    pick = lambda s: F.when(has, s["f1"]).otherwise(0.0)
    return [pick(rouge_n_column(summary, reference, n)) for n in (1, 2)] + [pick(rouge_l(summary, reference))]


def score(results: DataFrame, reference: str | None = None) -> DataFrame:
    """``results`` (doc_id, text, summary, facts) with a column for each score, rates rounded to four digits."""
    summary, source, facts = F.col("summary"), F.col("text"), F.col("facts")
    rouge = rouge_scores(summary, F.col(reference) if reference else None)
    rates = [*rouge, coverage(facts), citation_integrity(facts, source), numeric_fidelity(summary, source)]
    counts = [invalid_citations(facts, source), F.size(F.filter(facts, lambda f: is_claim_like(f["text"]))), F.size(all_spans(facts))]
    values = [F.round(r, 4) for r in rates] + counts
    return results.select("*", *[v.alias(n) for v, n in zip(values, SCORES, strict=True)], unsupported_numbers(summary, source).alias("unsupported_numbers"))


def aggregate(scores: DataFrame, *by: str) -> DataFrame:
    """Means of the rounded scores, rounded again, and the number of documents."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(n), 4).alias(n) for n in SCORES], F.count("*").alias("n_docs"))
