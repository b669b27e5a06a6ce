import numpy as np
import pytest

from spanloom.llm import toxicity as t
from tests.llm.helpers import awkward, labels, same_values, write_tables


def brute_isotonic(score, y):
    """Least squares over all non-decreasing step functions, by min-max of block means."""
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order]
    knots = np.unique(s)
    lo = [np.flatnonzero(s == k)[0] for k in knots]
    hi = [np.flatnonzero(s == k)[-1] + 1 for k in knots]
    return [max(min(v[lo[i] : hi[j]].mean() for j in range(k, len(knots))) for i in range(k + 1)) for k in range(len(knots))]


def test_isotonic():
    rng = np.random.default_rng(0)
    score, y = rng.integers(0, 15, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    knots, levels = t.isotonic(score, y)
    assert levels == pytest.approx(brute_isotonic(score, y))


def test_trees_separate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = t.fit_trees(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features_are_finite_for_odd_texts():
    odds = t._Odds(dict.fromkeys(t.INSULTS, 4.0), {})
    for text in (None, "", " ", "😀" * 50, "!" * 1000, "i.d.i.o.t you 1d10t", "x" * 100_000):
        row = t.features(text, odds)
        assert len(row) == len(t.FEATURES) and np.isfinite(row).all()
    assert t.features("you 1d10t and i-d-i-o-t", odds)[t.FEATURES.index("obfuscated")] == 2


def held_out(spark, sf):
    out = t.op4_toxicity(spark, f"/root/testdata/{sf}").toPandas()
    out = out.merge(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").toPandas(), on="doc_id")
    return out[out.held_out]


def test_held_out_accuracy(spark):
    held = held_out(spark, "sf0.1")
    rank, pos = held.score.rank(), held.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.97
    hits = held[held.predicted == 1]
    assert hits.toxic.mean() >= 0.95 and hits.toxic.sum() / pos.sum() >= 0.9


def test_few_labels_are_enough_to_find_most(spark):
    held = held_out(spark, "sf0.01")
    hits = held[held.predicted == 1]
    assert hits.toxic.mean() >= 0.9 and hits.toxic.sum() / (held.toxic == 1).sum() > 0.5


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "!" * 1_000_000, "@1" * 500_000, "a.b-" * 250_000, "_" * 1_000_000, "A1 " * 330_000])
def test_long_runs_take_linear_time(text):
    import time

    began = time.process_time()
    t.features(text, t._Odds(dict.fromkeys(t.INSULTS, 4.0), {"abcd": 2.0}))
    assert time.process_time() - began < 2


def test_scores_do_not_see_labels_of_the_held_out_fold(spark, tmp_path):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality", "toxic").collect()
    flipped = [(d, q, 1 - x if zlib.crc32(str(d).encode()) % 3 == 1 else x) for d, q, x in rows]
    scores = []
    for k, some in enumerate((rows, flipped)):
        folder = write_tables(docs, labels(spark, some), str(tmp_path / str(k)))
        scores.append(sorted(tuple(r) for r in t.op4_toxicity(spark, folder).collect()))
    assert scores[0] == scores[1]


def test_awkward_rows(spark):
    df = awkward(spark)
    for some in ([], [(1, 1, 1), (1, 1, 0), (99, 1, 1), (3, None, None), (None, 1, 1)]):
        out = t.score_documents(df, labels(spark, some))
        assert out.columns == [*df.columns, "__toxicity_"] and same_values(df, out)
        assert all(0 <= r[0] <= 1 for r in out.select("__toxicity_").collect())
    assert t.score_documents(df.limit(0), labels(spark)).count() == 0


@pytest.mark.parametrize("word", sorted(t.SECOND_PERSON))
def test_every_second_person_word_counts(word):
    assert t.features(f"{word} a x", t._Odds({}, {}))[t.FEATURES.index("you_density")] == pytest.approx(100 / 3)
