"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

Only DataFrame functions. Statistics of whole texts are array expressions inside a row, so nothing
is shuffled to compute them. Rules are conjunctions of thresholds: each is grown on one part of the
labelled rows by information gain, pruned on the other part, and kept only if it is precise there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract.
MIN_WORDS, MAX_REPEATED, SYMBOLS = 50, 50, "#*$%&|<>"
#: About the most labelled rows that rules are learned from, thresholds tried for a feature, literals of a
#: rule, rules of a list; the least precision and cover of a rule on the pruning part.
MAX_ROWS, CUTS, MAX_LITERALS, MAX_RULES, MIN_PRECISION, MIN_COVER = 50_000, 32, 3, 8, 0.9, 5
#: Statistics that rules may test.
FEATURES = (
    "n_words", "mean_word", "symbol_rate", "duplicate_lines", "repeated_words", "distinct_words", "exclamation_rate", "words_per_line",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` as the struct ``row``, plus ``s``: a struct of the base counts and of the features.

    A null text has no words; rates of a text without words are 0. Windows of three words are compared
    by their 64-bit hashes, so counts of repeats are exact but for collisions of these.
    """
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    inner = F.btrim(text, F.lit(common.SPACE_CHARS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACE_CHARS)) != "")
    df = docs.withColumn("__w", words).withColumn("__l", lines)
    size = F.size("__w")
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(3)])
    )
    df = df.withColumn("__h", F.when(size >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    hash_at = lambda k: F.get("__p", k)["h"]
    # get() gives null outside the array, and null is no match
    again = F.filter("__p", lambda x, k: F.coalesce((x["h"] == hash_at(k - 1)), F.lit(False)) | F.coalesce(x["h"] == hash_at(k + 1), F.lit(False)))
    df = df.withColumn("__r", F.sort_array(F.transform(again, lambda x: x["i"])))
    spans = F.transform("__r", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("__r", k + 1) - v, F.lit(3))))
    n_symbols = reduce(lambda a, b: a + b, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS])
    counts = F.struct(
        size.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").alias("n_lines"),
        F.size(F.array_distinct("__w")).alias("n_distinct"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_exclaims"),
    )
    df = df.withColumn("__c", counts).drop("__w", "__l", "__h", "__p", "__r")
    rate = lambda a, b: F.col(f"__c.{a}") / F.greatest(F.col(f"__c.{b}"), F.lit(1)).cast("double")
    features = (
        F.col("__c.n_words").cast("double"), rate("word_chars", "n_words"), rate("n_symbols", "n_words"), rate("n_dup_lines", "n_lines"),
        rate("n_repeat_words", "n_words"), rate("n_distinct", "n_words"), rate("n_exclaims", "n_words"), rate("n_words", "n_lines"),
    )
    base = [F.col(f"__c.{c}").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    rates = F.struct(*[f.alias(n) for n, f in zip(FEATURES, features, strict=True)])
    whole = F.struct(F.col("__c.n_words").alias("n_words"), *base, rates.alias("f"))
    # As a generated column it is computed once: a filter on it can't be pushed below and repeat the work.
    return df.withColumn("s", F.explode(F.array(whole))).drop("__c")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Literal, ...]


def _holds(rule: Rule, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [x.column(prefix) for x in rule], F.lit(True))


def verdict(rules: list[Rule], prefix: str = "s.f.") -> Column:
    """The decision list as one ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule, prefix), False) if out is None else out.when(_holds(rule, prefix), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _gain(bad: float, all_: float, bad0: float, all0: float) -> float:
    return bad * (math.log2(bad / all_) - math.log2(bad0 / all0)) if bad else 0.0


def _best_literal(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Literal | None, float, float]:
    """The literal of most gain over ``rows``, from one count of rows and bad rows by feature and bin."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__b{k}").alias("b")) for k in range(len(FEATURES))]))
    counts = rows.select("bad", cells.alias("c")).groupBy("c.k", "c.b").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    table: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        table.setdefault(r["k"], {})[r["b"]] = (r["bad"], r["n"])
    bad0, all0 = (sum(v[i] for v in table.get(0, {}).values()) for i in (0, 1))
    best, literal = 1e-9, None
    if not bad0:
        return None, 0, all0
    for k, name in enumerate(FEATURES):
        bad = n = 0
        for b, cut in enumerate(cuts[name]):
            x = table[k].get(b, (0, 0))
            bad, n = bad + x[0], n + x[1]
            for above, p, q in ((False, bad, n), (True, bad0 - bad, all0 - n)):
                if q >= MIN_COVER and (g := _gain(p, q, bad0, all0)) > best:
                    best, literal = g, Literal(name, above, cut)
    return literal, bad0, all0


def _centred(literal: Literal, rows: DataFrame) -> Literal:
    """The literal with its cut in the middle of the gap between the values on its two sides."""
    value = F.col(literal.feature)
    gap = rows.agg(F.max(F.when(value <= literal.cut, value)).alias("lo"), F.min(F.when(value > literal.cut, value)).alias("hi")).first()
    if gap["lo"] is None or gap["hi"] is None:
        return literal
    return Literal(literal.feature, literal.above, (gap["lo"] + gap["hi"]) / 2)


def learn_rules(stats: DataFrame) -> list[Rule]:
    """A decision list from rows of features and ``bad`` (0 or 1) with ``part`` (0 to 2; 2 prunes).

    Only counts by feature and bin reach the driver. Without bad or good rows the list is empty.
    """
    shares = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    wanted = [F.percentile_approx(n, F.lit(shares), F.lit(2000)).alias(n) for n in FEATURES]
    worst = [F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), F.lit(shares), F.lit(2000)).alias("b_" + n) for n in FEATURES]
    found = stats.agg(*wanted, *worst).first()
    cuts = {n: sorted({*(found[n] or []), *(found["b_" + n] or [])}) for n in FEATURES}
    for k, n in enumerate(FEATURES):
        edges = F.lit(cuts[n]).cast("array<double>") if cuts[n] else F.array().cast("array<double>")
        value = F.col(n)
        stats = stats.withColumn(f"__b{k}", F.size(F.filter(edges, lambda e: e < value)))  # noqa: B023
    stats = common.materialise(stats, "quality-bins")
    grow, prune, rules = stats.where("part < 2"), stats.where("part = 2"), []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        while len(rule) < MAX_LITERALS:
            literal, bad, n = _best_literal(grow.where(left & _holds(rule)), cuts)
            if literal is None or n == bad:
                break
            rule = (*rule, _centred(literal, grow.where(left & _holds(rule))))
        if not rule:
            break
        sums = [f(F.when(_holds(rule[:k]), x)) for k in range(1, len(rule) + 1) for f, x in ((F.sum, F.col("bad")), (F.count, F.lit(1)))]
        seen = prune.where(left).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        ranked = [((2 * (seen[2 * k] or 0) - seen[2 * k + 1]) / max(1, seen[2 * k + 1]), -k) for k in range(len(rule))]
        k = -max(ranked)[1]
        bad, n = seen[2 * k] or 0, seen[2 * k + 1]
        if n < MIN_COVER or bad < MIN_PRECISION * n:
            break
        rules.append(rule[: k + 1])
        left = left & ~_holds(rules[-1])
    common.remove(stats)
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules against ``labels.quality`` = 0 from about ``max_rows`` labelled documents, chosen by a hash.

    Documents that the base rules reject teach nothing new and are left out.
    """
    some = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    some = common.hash_sample(some, max_rows, "doc_id")
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    part = F.pmod(F.xxhash64(F.col("row.doc_id"), F.lit("part")), F.lit(3)).cast("int")
    rows = rows.where(~_base_failed()).select("s.f.*", (F.col("row.quality") == 0).cast("int").alias("bad"), part.alias("part"))
    rows = common.materialise(rows, "quality-rows")
    rules = learn_rules(rows)
    common.remove(rows)
    return rules


def _base_failed() -> Column:
    return (F.col("s.n_words") < MIN_WORDS) | (100 * F.col("s.n_repeat_words") > MAX_REPEATED * F.col("s.n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``__s`` (base counts and features), ``__base_failed`` and ``__kept``.

    Defined cases: a null or blank text has no words and fails; repeated rows repeat; an empty table
    stays empty; other columns, whatever their names, pass through, and where one already has the
    name of a new column, the new one gets underscores behind it.
    """
    statistics, failed, kept = common.fresh(docs, "__s", "__base_failed", "__kept")
    judged = with_statistics(docs).select("row", "s", _base_failed().alias("failed"), (~_base_failed() & verdict(rules)).alias("kept"))
    return judged.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("s").alias(statistics), F.col("failed").alias(failed), F.col("kept").alias(kept)
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`judge` over all documents.

    Defined cases: a null or blank text has no words and fails; repeated rows repeat; labels without
    a value are left out, and of several for one document the lowest counts; without labels of both
    kinds the base rules alone decide; an empty table gives no rows.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judge(docs, rules).select(
        "doc_id", *[F.col(f"__s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"),
    )
