import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing
from tests.llm.helpers import awkward


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare the excess by weight until no source is above its limit."""
    w = {s: weights[k % 3] for k, s in enumerate(sizes)}
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = share * sum(sizes.values()) - sum(target[s] for s in sizes if s not in open_)
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else left * w[s] / total
        open_ -= over or open_
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 30}, {"a": 1}, {"a": 0, "b": 7}, {"a": 100, "b": 100, "c": 100, "d": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_taken_is_the_rounded_target(spark, sf):
    out = mixing.op10_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect():
        assert abs(r["t"] - r["target"]) <= 0.5
    assert out.where("taken > 2 * size or taken < 0").count() == 0


def test_reruns_and_partitions_agree(spark, sf):
    a = sorted(tuple(r) for r in mixing.op10_mixing(spark, sf).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(tuple(r) for r in mixing.op10_mixing(spark, sf).collect()) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_against_sql(spark, duck, sf):
    cols = "doc_id, size, source_size, target, taken"
    want = sorted(duck.sql(mixing.OP10_SQL).select(cols).fetchall())
    got = sorted(tuple(r) for r in mixing.op10_mixing(spark, sf).select(*cols.split(", ")).collect())
    assert got == want


def test_awkward_rows(spark):
    df = awkward(spark)
    sized = df.select("doc_id", "source", mixing.n_words().alias("size"))
    out = mixing.mix(sized)
    assert out.count() == df.count()
    assert mixing.mix(sized.limit(0)).count() == 0
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() > 0
    assert mixed.where("text is null").count() == 2
    assert mixed.exceptAll(df.union(df)).count() == 0  # each row whole, at most twice
