import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe
from tests.llm.helpers import LONG, awkward, same_values

PATH = public_tokenizers.path(bpe.RANKS)
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'", "l", "1", "22", "é", "ñ", "!", "中", "文", "\t", "\x1c", "😀", "don't", "we'll", " "]


def library(text):
    return bpe.encoding(PATH).encode_ordinary(text or "")


def stitched(text, chunk, overlap):
    """The chunks of one text, met and encoded piece by piece; None where neighbours share no boundary."""
    start, out = 0, b""
    for _, part in bpe.chunk_rows(text, chunk, overlap):
        end = len(part)
        if len(part) > chunk:
            end = bpe.meeting(part, chunk)
            if end is None:
                return None
        out += bpe.encode_piece(part, PATH, start, end)
        start = end - chunk
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join), st.sampled_from([(8, 8), (16, 8), (16, 12)]))
def test_chunks_give_the_ids_of_the_whole_text(text, how):
    got = stitched(text, *how)
    assert got is None or np.frombuffer(got, "<u4").tolist() == library(text)
    assert bpe.decode_ids(bpe.encode_piece(text, PATH), PATH) == text.encode()


def test_pre_tokens_are_the_library_s_for_every_code_point():
    """The two libraries must agree on the classes of the pattern, whatever their versions of Unicode."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2000):
        text = " ".join(f"a{c}a 1{c}1 !{c}! {c}{c}" for c in points[at : at + 2000])
        assert np.frombuffer(bpe.encode_piece(text, PATH), "<u4").tolist() == library(text)


@pytest.mark.parametrize("text", [" " * 200_000 + "a", "a" * 150_000, "\n" * 100_000, "中" * 100_000])
def test_runs_without_boundaries(text):
    assert bpe.decode_ids(bpe.encode_piece(text, PATH), PATH) == text.encode()


def want(rows):
    out = []
    for d, t in rows:
        ids = library(t)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)


def test_query(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert rows_of(bpe.op9_bpe(spark, sf)) == want(texts.collect())


def test_small_chunks_over_all_texts(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert rows_of(bpe.token_digests(texts, chunk=64, overlap=32)) == want(texts.collect())


def test_texts_whose_chunks_never_meet_go_round_again(spark):
    rng = random.Random(2)
    words = " ".join(rng.choice(PARTS) + "x" for _ in range(3000))
    texts = ["a" * 500 + " b" * 90, words + " " * 700 + words, words, words, " " * 5000, "x" * 20 + words]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(bpe.token_digests(df, chunk=64, overlap=16)) == want(enumerate(texts))


def test_a_long_text_is_spread(spark):
    """The chunks of a single text reach many tasks."""
    text = " ".join(f"w{k}" for k in range(400_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr("sha2(text, 256) as key", "text")
    parts = df.mapInPandas(bpe._cut(bpe.CHUNK, bpe.OVERLAP), "key string, k int, part string").repartition(8, "key", "k")
    assert sum(n > 0 for n in parts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 6
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert rows_of(bpe.token_digests(df)) == want([(1, text), (2, text)])


def test_awkward_rows(spark):
    df = awkward(spark)
    out = {r["doc_id"]: r for r in bpe.token_digests(df).collect()}
    assert bpe.token_digests(df).count() == df.count()
    assert out[1]["n_tokens"] == out[2]["n_tokens"] == 0
    assert out[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[3]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.token_digests(df.limit(0)).count() == 0
    odd = bpe.encode_documents(df, chunk=1000, overlap=64)
    assert odd.columns == [*df.columns, "__ids_", "__decoded_"] and same_values(df, odd)
    assert rows_of(bpe.token_digests(df, chunk=1000, overlap=64)) == want((r["doc_id"], r["text"]) for r in df.collect())
