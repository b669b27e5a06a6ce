from pyspark.sql import functions as F

from spanloom.llm import line_dedup
from tests.llm.helpers import awkward, same_values


def test_awkward_rows(spark):
    df = awkward(spark)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "__n_lines_", "__n_dropped_"] and same_values(df, out, but=["text"])
    got = {r["doc_id"]: r for r in out.where("doc_id >= 10").collect()}
    for k in range(5):
        assert got[10 + k]["text"] == f"start {k}\nend {k}" and got[10 + k]["__n_dropped_"] == 2 and got[10 + k]["__n_lines_"] == 4
    assert got[15]["__n_dropped_"] == 0 and "This passage" in got[15]["text"]
    assert {r["text"] for r in out.where("doc_id = 1").collect()} == {""}
    assert out.where("doc_id = 3").select(F.length("text")).first()[0] == 150_000


def test_empty_table(spark):
    assert line_dedup.dedup_lines(awkward(spark).limit(0)).count() == 0


def test_four_documents_are_too_few(spark):
    df = awkward(spark).where("doc_id between 10 and 13")
    assert line_dedup.dedup_lines(df).agg(F.sum("__n_dropped_")).first()[0] == 0


def test_ascii_only_case_folding():
    assert line_dedup.line_key(" \x0bÀB\r".encode()) == "Àb".encode()


def test_against_sql(spark, duck, sf):
    want = sorted(duck.sql(line_dedup.OP6_SQL).select("doc_id, n_lines, n_dropped, kept_sha256").fetchall())
    got = sorted(tuple(r) for r in line_dedup.op6_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want


def test_lines_that_are_too_many_to_broadcast(spark, sf, monkeypatch):
    from spanloom.llm import common

    rows = lambda: sorted(map(tuple, line_dedup.op6_line_dedup(spark, sf).collect()))
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert rows() == want
