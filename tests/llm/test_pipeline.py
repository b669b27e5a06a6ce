import importlib.util

import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, line_dedup, mixing, simhash_dedup
from tests.llm.helpers import awkward, labels, write_tables

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") is None else __import__("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_input(spark, sf, tmp_path):
    docs, outs = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs.append(docs)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    for out in outs[:-1]:
        assert out.columns == COLUMNS
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    start = spark.read.parquet(f"{sf}/documents.parquet")
    clean = start.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0"), "doc_id")
    assert clean.join(outs[0], "doc_id", "left_anti").count() <= 0.05 * clean.count()
    # line dedup: same documents, lines as the operator's SQL drops them
    assert outs[1].count() == outs[0].count()
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(outs[0]).collect()}
    assert {r["doc_id"]: r["text"] for r in outs[1].collect()} == want
    # one of each group
    groups = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicate_groups(outs[1]).collect()}
    assert sorted(r["doc_id"] for r in outs[2].collect()) == sorted(set(groups.values()))
    # sources near their targets, texts whole, at most twice
    sizes = outs[2].withColumn("n", mixing.n_words()).groupBy("source").agg(F.sum("n").alias("source_size"), F.count("*").alias("n"))
    target = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    largest = outs[2].withColumn("n", mixing.n_words()).agg(F.max("n")).first()[0]
    for r in outs[3].withColumn("n", mixing.n_words()).groupBy("source").agg(F.sum("n").alias("n")).collect():
        assert abs(r["n"] - target[r["source"]]) <= largest / 2 + 1
    assert outs[3].groupBy("doc_id").count().where("count > 2").count() == 0
    assert outs[3].join(outs[2], ["doc_id", "text"], "left_anti").count() == 0
    # encoded documents
    assert outs[4].count() == outs[3].count()
    path = bpe.public_tokenizers.path(bpe.RANKS)
    want = sorted((r["doc_id"], len(bpe.encoding(path).encode_ordinary(r["text"]))) for r in outs[3].collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in outs[4].collect()) == want


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    for k, some in enumerate((df, df.limit(0))):
        folder = write_tables(some.select(*COLUMNS), labels(spark), str(tmp_path / str(k)))
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        pipeline.STAGES[-1][1](spark, docs, folder).collect()


def most_workers(df):
    """The most Python workers that one task of the plan keeps: its Python nodes between two exchanges."""
    most = 0

    def of(node):
        nonlocal most
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return of(node.initialPlan())
        name, children = node.nodeName(), node.children()
        below = [of(children.apply(i)) for i in range(children.size())]
        n = (max if name == "Union" else sum)(below or [0]) + ("EvalPython" in name or "InPandas" in name)
        most = max(most, n)
        return 0 if "Exchange" in name else n

    of(df._jdf.queryExecution().executedPlan())
    return most


def test_a_task_keeps_one_python_worker(spark, sf, tmp_path, monkeypatch):
    """Workers live on from stage to stage, so every further one of a task is paid for by all of them."""
    written, materialise = [], simhash_dedup.common.materialise
    monkeypatch.setattr(simhash_dedup.common, "materialise", lambda df, name: written.append((name, most_workers(df))) or materialise(df, name))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        written.append((name, most_workers(out)))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert ("simhash", 1) in written
    assert [x for x in written if x[1] > 1] == []
