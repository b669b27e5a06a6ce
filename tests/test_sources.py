"""Files, archives, CSV tables and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators import validate
from spanloom.sources import files, tables
from spanloom.streaming import documents as stream


def test_read_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"\xef\xbb line\r\none\rtwo \n")
    (folder / "b.md").write_text("  # é  ", encoding="utf-8")
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>A<w:tab/>B</w:t></w:p><w:p></w:p><w:p>C</w:p></w:document>")
    (folder / "d.docx").write_bytes(b"no zip")
    out = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(folder)).collect()}
    assert out["a.txt"]["text"] == "� line\none\ntwo" and out["b.md"]["text"] == "# é"
    assert out["c.docx"]["text"] == "One &amp; two\n\nA\tB\n\nC"
    assert out["d.docx"]["text"] is None and out["d.docx"]["error"]


def test_rejected_uploads(spark):
    rows = [("/u/a.exe", bytearray(b"x"), "x"), ("/u/a.txt", bytearray(b""), ""), ("/u/b.TXT", bytearray(b" "), " "), ("/u/c.md", bytearray(b"ok"), "ok")]
    df = spark.createDataFrame(rows, "path string, content binary, text string")
    assert [(r["reject_reason"], r["status"]) for r in files.rejected_uploads(df).collect()] == [("unsupported suffix", 400), ("empty", 400), ("no text", 400), (None, None)]


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pairs.zip", "w") as z:
        for n in (10, 2, 1, 3):
            z.writestr(f"x/fulltext/case_{n}.txt", f" text {n} ")
            z.writestr(f"x/summaries/case_{n}_sum.txt", "" if n == 1 else f"sum {n}\n")
        z.writestr("x/fulltext/alone_7.txt", "t")
        z.writestr("x/fulltext/inner.zip", "no")
    got = files.load_archive(spark, str(tmp_path / "pairs.zip"), limit=2).collect()
    assert [(r["doc_id"], r["text"], r["reference"]) for r in got] == [("case_2", "text 2", "sum 2"), ("case_3", "text 3", "sum 3")]
    assert got[0]["meta"]["source"] == "pairs.zip"
    (tmp_path / "pairs.zip").rename(tmp_path / "corpus_gs_train_en.zip")
    assert [r["doc_id"] for r in files.load_archive(spark, str(tmp_path)).collect()] == ["case_2", "case_3", "case_10"]
    assert [r["doc_id"] for r in files.load_archive(spark, str(tmp_path), limit=0).collect()] == []
    with pytest.raises(ValueError):
        files.load_archive(spark, str(tmp_path), lang="xx")


def test_archive_reads_no_more_pairs_than_a_limit_takes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for n in range(300):
            z.writestr(f"x/fulltext/case_{n}.txt", f"text {n}" if n > 100 else " ")
            z.writestr(f"x/summaries/case_{n}_sum.txt", f"sum {n}")
    got = files.load_archive(spark, str(tmp_path / "many.zip"), limit=3).collect()
    assert [r["doc_id"] for r in got] == ["case_101", "case_102", "case_103"]
    assert files.archive_name("ls", "fr") == "corpus_large-scale_train_fr.zip"
    for bad in (("gs", "de"), ("xx", "en")):
        with pytest.raises(ValueError):
            files.archive_name(*bad)


def test_dialogues_and_pairs(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes('﻿ID,section_header,section_text,dialogue\r\n0,GENHX,"A ""b""\nc",Doctor: x\r\n1,CC,,y\r\n2,CC,z,w\r\n'.encode())
    rows = tables.load_dialogues(spark, str(path), "train", prefix="talk").collect()
    assert [(r["doc_id"], r["reference"], r["meta"]["section_header"]) for r in rows] == [("talk-train-0", 'A "b"\nc', "GENHX"), ("talk-train-2", "z", "CC")]
    assert tables.load_corpus(spark, "dialogues", str(path), limit=1).count() == 1
    with pytest.raises(ValueError):
        tables.load_corpus(spark, "other", str(path))
    left = tables.read_csv(spark, str(path)).select("ID")
    right = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert sorted((r["pos"], r["ID"]) for r in tables.positional_pairs(left, right).collect()) == [(0, "0"), (1, "1"), (2, "2")]
    with pytest.raises(ValueError):
        tables.positional_pairs(left, right.limit(2))
    assert [r["doc_id"] for r in tables.load_dialogues(spark, str(path), "train", limit=1).collect()] == ["dialogue-train-0"]
    right.repartition(3).write.parquet(str(tmp_path / "several"))
    with pytest.raises(ValueError):
        tables.positional_pairs(left, spark.read.parquet(str(tmp_path / "several")))
    tables.write_csv(right, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_blocks_and_discrimination(spark):
    df = spark.createDataFrame([(k, float(k % 3)) for k in range(250)], "pos long, x double")
    assert [(r["block"], r["n"]) for r in validate.block_means(df, "pos", ["x"]).orderBy("block").collect()] == [(0, 100), (1, 100), (2, 50)]
    row = validate.label_discrimination(df, ["x"]).first()
    assert row["zero_share"] == pytest.approx(84 / 250) and row["max"] == 2.0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, "One. Two here. Three 3.5", f"2024-01-01 00:{k:02d}:00") for k in range(30)], "doc_id long, text string, ts string")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    counts = stream.counts_by_window(stream.read_stream(spark, str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = sorted(tuple(r)[1:] for r in spark.table("counts").collect())
    assert got == [(10, 30, 50)] * 3
    assert sorted(tuple(r)[1:] for r in stream.counts_by_window(rows).collect()) == got
