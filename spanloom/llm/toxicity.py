"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The model is fitted on a bounded sample of labelled rows (about ``max_rows``, chosen by a hash of
the doc_id); it never sees labels of the held-out fold, nor lang, source or doc_id as inputs. All of
these rows serve every step by cross-fitting: they are dealt into parts, the features of a part come
from a lexicon learned without it, and the calibration reads scores of trees grown without it. The
score is the isotonic level with a share of 2 % of the raw probability, which only orders texts
inside a level; it is not the bare isotonic value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract.
FOLDS, HELD_OUT, REJECT = 3, 1, 0.7
#: About the most labelled rows that a model is fitted on, chosen by a hash.
MAX_ROWS = 20_000
#: Parts of the labelled rows for cross-fitting; the least rows of each label that are needed to learn.
PARTS, LEAST_LABELS = 5, 10
#: Counts that a task holds before it hands them on.
HELD_TERMS = 1 << 16
#: Share of the raw probability that orders texts inside an isotonic level.
RAW_SHARE = 0.02
#: Learned lexicon: lengths of word beginnings, the least toxic documents that hold an entry, the
#: least log odds, and the most entries.
STEMS, MIN_TOXIC, MIN_ODDS, MAX_ENTRIES = (4, 5, 6, 7), 3, 1.5, 600
#: Common English insults, the start of the lexicon whatever the labels hold.
INSULTS = """
asshole bastard bitch bullshit clown coward crap creep cretin cunt dickhead disgusting dumb dumbass
fool freak garbage idiot idiotic imbecile jackass jerk liar loser lunatic maggot moron moronic
pathetic pig psycho rat retard scum scumbag shit slut stupid swine trash vermin whore worthless
""".split()
#: Second-person words of the table's four languages.
SECOND_PERSON = frozenset("you your yours yourself ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tus vosotros".split())
#: Look-alike characters and the letters they stand for.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
FEATURES = (
    "log_words", "insults", "insult_density", "strong", "strong_density", "medium_density", "odds_density",
    "largest_odds", "distinct_strong", "near_you", "you_density", "capitals", "shouted", "exclamations",
    "punctuation", "digits", "obfuscated", "symbols",
)
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"\S+")
_SPLIT_UP = re.compile(r"(?<!\w)(?:\w[.\-_*]){3,}\w(?!\w)")
#: Signs that hide letters, and lengths of words that may hide an insult.
_HIDING, _HIDDEN_CHARS = re.compile(r"[0-9@$!*]"), (4, 20)
_LETTER = re.compile(r"[A-Za-z]")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT, _SYMBOL = b".,;:!?\"'()-", b"#*$%&|<>@~^"


def _rate(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


class _Odds(dict):
    """Log odds by word, from the lexicon's entries on whole words and word beginnings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> float:
        found = [self.words[word]] if word in self.words else []
        found += [self.stems[word[:n]] for n in STEMS if word[:n] in self.stems and len(word) >= n]
        value = max(found, default=0.0)
        if len(self) > 200_000:
            self.clear()
        self[word] = value
        return value


def features(text: str | None, odds: _Odds) -> list[float]:
    """The dense features of a whole text; an empty text has zeros."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    n, size = max(1, len(words)), max(1, len(text))
    weights = list(map(odds.__getitem__, words))
    strong = [i for i, w in enumerate(weights) if w >= 3.0]
    medium = sum(1.5 <= w < 3.0 for w in weights) if max(weights, default=0) > 0 else 0
    insults = sum(words[i] in _INSULT_SET for i in strong)
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - 5) : i + 6]) for i in strong)
    you = sum(map(SECOND_PERSON.__contains__, words))
    hidden = 0
    if _HIDING.search(text):
        runs = {r for r in _RUN.findall(text) if _HIDDEN_CHARS[0] <= len(r) <= _HIDDEN_CHARS[1]}
        for part in runs:
            if _HIDING.search(part) and _LETTER.search(part):
                bare = part.lower().strip("!.,;:*")
                plain = bare.translate(LOOKALIKE)
                hidden += plain != bare and odds.words.get(plain, 0.0) >= 3.0
    hidden += sum(odds.words.get(re.sub(r"\W|_", "", m), 0.0) >= 3.0 for m in _SPLIT_UP.findall(lower))
    raw = text.encode()
    shouted = sum(len(w) > 2 for w in re.findall(r"\b[A-Z]{3,}\b", text))
    return [
        math.log1p(len(words)), insults, 100 * insults / n, len(strong), 100 * len(strong) / n, 100 * medium / n,
        100 * sum(weights) / n, max(weights, default=0.0), len({words[i] for i in strong}), near, 100 * you / n,
        _rate(raw, _UPPER) / size, shouted / n, _rate(raw, b"!") / size, _rate(raw, _PUNCT) / size,
        _rate(raw, _DIGIT) / size, hidden, _rate(raw, _SYMBOL) / size,
    ]


_INSULT_SET = frozenset(INSULTS)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Boosted regression trees on the log odds; a tree is (feature, threshold, left, right, value) arrays."""

    base: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            out += value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, leaf: int | None = None) -> Trees:
    """Newton boosting of the logistic loss on quantile histograms; at least ``leaf`` rows in a leaf.

    Without a number the least leaf grows with the rarer label, from 2 to 20 rows.
    """
    leaf = leaf or int(np.clip(min(y.sum(), (1 - y).sum()) // 8, 2, 20))
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(math.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    n_features = x.shape[1]
    # The cells of all features lie in one array, so one count over rows and features fills a node's histograms.
    cells = np.stack([np.searchsorted(e, x[:, f], side="left") + f * bins for f, e in enumerate(edges)], axis=1)
    no_cut = np.stack([np.arange(bins) >= len(e) for e in edges])
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        nodes: list[list[float]] = []

        def sums(rows: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
            each = None if weight is None else np.repeat(weight[rows], n_features)
            return np.bincount(cells[rows].ravel(), each, n_features * bins).reshape(n_features, bins).cumsum(axis=1)

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, -1, -1, rate * gs / (hs + 1.0)])
            if level == depth or len(rows) < 2 * leaf:
                return at
            gl, hl, nl = sums(rows, g), sums(rows, h), sums(rows, None)
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < leaf) | (len(rows) - nl < leaf) | no_cut] = -1
            best = int(gain.argmax())
            if gain.flat[best] > 1e-3:
                f, cut = divmod(best, bins)
                go = cells[rows, f] <= best
                nodes[at][:2] = [f, edges[f][cut]]
                nodes[at][2] = grow(rows[go], level + 1)
                nodes[at][3] = grow(rows[~go], level + 1)
            return at

        grow(np.arange(len(y)), 0)
        t = np.array(nodes)
        tree = (t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4])
        model.trees.append(tree)
        score += Trees(0.0, [tree]).raw(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the best non-decreasing fit."""
    order = np.argsort(score, kind="stable")
    knots, where = np.unique(score[order], return_inverse=True)
    n = np.bincount(where).astype(float)
    mean = np.bincount(where, y[order]) / n
    blocks: list[list[float]] = []
    for k in range(len(knots)):
        blocks.append([mean[k], n[k], 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, c = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + c]
    return knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    """A lexicon, trees over the features, and the calibration of their score."""

    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees
    knots: np.ndarray
    levels: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score: the isotonic level, and a share of the raw probability to order texts inside a level."""
        raw = self.trees.raw(x)
        step = np.interp(raw, self.knots, self.levels)
        return np.clip((1 - RAW_SHARE) * step + RAW_SHARE / (1 + np.exp(-raw)), 0.0, 1.0)


# ---------------------------------------------------------------- fitting and scoring on Spark


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic, part) of labelled rows outside the held-out fold, dealt into ``PARTS`` parts by a hash."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = (
        labels.where("toxic is not null and doc_id is not null").where(fold % FOLDS != HELD_OUT)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    rows = common.hash_sample(rows, max_rows, "doc_id")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(PARTS))
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(rows), "doc_id").select("text", "toxic", part.cast("int").alias("part"))


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by term, label and part: whole words behind w, word beginnings behind s. Counts are handed on in parts."""
    seen: Counter = Counter()

    def handed_on() -> pd.DataFrame:
        return pd.DataFrame({"term": [t for t, _ in seen], "cell": [c for _, c in seen], "n": list(seen.values())})

    for batch in batches:
        for text, label, part in zip(batch["text"], batch["toxic"], batch["part"]):
            words = set(_WORD.findall((text or "").lower()))
            terms = {"w" + w for w in words if len(w) > 2} | {"s" + w[:n] for w in words for n in STEMS if len(w) >= n}
            cell = 2 * int(part) + (label > 0)
            seen.update((t, cell) for t in terms)
            if len(seen) >= HELD_TERMS:
                yield handed_on()
                seen.clear()
    if seen:
        yield handed_on()


Lexicon = tuple[dict[str, float], dict[str, float]]


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Log odds of whole words and word beginnings from document counts; only the best entries reach the driver.

    One lexicon without each part, and at the end one of all rows.
    """
    at_cell = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}")
    cell = (2 * F.col("part") + (F.col("toxic") > 0).cast("int")).alias("cell")
    totals = rows.select(cell, F.lit(1).alias("n")).agg(*[at_cell(c) for c in range(2 * PARTS)]).first()
    counts = rows.select("text", "toxic", "part").mapInPandas(_count_terms, "term string, cell int, n long")
    counts = counts.groupBy("term").agg(*[at_cell(c) for c in range(2 * PARTS)])
    toxic_docs = sum((F.col(f"n{2 * p + 1}") for p in range(PARTS)), F.lit(0))
    counts = common.materialise(counts.where(toxic_docs >= MIN_TOXIC), "toxicity-terms")
    best = []
    for left_out in range(PARTS + 1):
        parts = [p for p in range(PARTS) if p != left_out]
        toxic, clean = (sum((F.col(f"n{2 * p + k}") for p in parts), F.lit(0)) for k in (1, 0))
        all_toxic, all_clean = (sum(totals[f"n{2 * p + k}"] or 0 for p in parts) + 1 for k in (1, 0))
        odds = F.log((toxic + 0.5) / all_toxic) - F.log((clean + 0.5) / all_clean)
        some = counts.select(F.lit(left_out).alias("left_out"), "term", toxic.alias("toxic"), F.round(odds, 3).alias("odds"))
        some = some.where((F.col("toxic") >= MIN_TOXIC) & (F.col("odds") >= MIN_ODDS))
        best.append(some.orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(MAX_ENTRIES))
    lexicons: list[Lexicon] = [(dict.fromkeys(INSULTS, 4.0), {}) for _ in best]
    for row in reduce(DataFrame.unionByName, best).collect():
        kind = lexicons[row["left_out"]][row["term"][0] == "s"]
        kind[row["term"][1:]] = max(kind.get(row["term"][1:], 0.0), row["odds"])
    common.remove(counts)
    return lexicons


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit lexicon, trees and calibration; with fewer than ``LEAST_LABELS`` rows of a label the fixed insults decide."""
    rows = common.materialise(training_rows(docs, labels, max_rows), "toxicity-rows")
    lexicons = learn_lexicons(rows)
    table = rows.select(_features(F.col("text"), F.col("part"), lexicons).alias("x"), "toxic", "part").toPandas()
    common.remove(rows)
    x = np.array(table["x"].tolist(), float).reshape(-1, len(FEATURES))
    y, part = (table["toxic"].to_numpy() > 0).astype(float), table["part"].to_numpy()
    order = np.lexsort((*x.T, y, part))  # the rows' places differ from run to run
    x, y, part = x[order], y[order], part[order]
    if min(y.sum(), (1 - y).sum()) < LEAST_LABELS:
        k = FEATURES.index("insults")
        tree = tuple(np.array(v) for v in ([k, -1, -1], [0.5, 0, 0], [1, -1, -1], [2, -1, -1], [0.0, -3.0, 3.0]))
        return Model(dict.fromkeys(INSULTS, 4.0), {}, Trees(0.0, [tree]), np.array([-3.0, 3.0]), np.array([0.05, 0.95]))
    unseen = np.zeros(len(y))
    for p in np.unique(part):
        unseen[part == p] = fit_trees(x[part != p], y[part != p]).raw(x[part == p])
    knots, levels = isotonic(unseen, y)
    return Model(*lexicons[-1], fit_trees(x, y), knots, levels)


def _features(text: Column, part: Column, lexicons: list[Lexicon]) -> Column:
    """Features of a labelled row, from the lexicon learned without its part."""

    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        odds = [_Odds(*lexicon) for lexicon in lexicons]
        for texts, parts in batches:
            yield pd.Series([features(t, odds[p]) for t, p in zip(texts, parts, strict=True)], dtype=object)

    return dense(text, part)


def score(text: Column, model: Model) -> Column:
    """The calibrated score of a text column, from 0 to 1."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        odds = _Odds(model.words, model.stems)
        for texts in batches:
            x = np.array([features(t, odds) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.predict(x))

    return scores(text)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Every input row with ``__toxicity``; fitted on the labels of the other folds.

    Nothing of the scoring is shuffled. Defined cases: a null text scores as an empty one; labels
    without a document or without a value are dropped, and of several for a document the highest
    counts; with too few labels a fixed lexicon rule scores 0.05 or 0.95; an empty table stays empty;
    repeated rows and other columns pass through, and where one already has the name of the new
    column, the new one gets underscores behind it.
    """
    common.small_batches(docs.sparkSession)
    model = fit(docs, labels, max_rows)
    return docs.withColumn(common.fresh(docs, "__toxicity")[0], score(F.col("text"), model))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`score_documents` over all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("__toxicity").alias("score"),
        (F.col("__toxicity") >= REJECT).cast("int").alias("predicted"),
    )
