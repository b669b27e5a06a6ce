import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import token_counts as tc
from tests.llm.helpers import awkward

VOCABULARY, RANKS = public_tokenizers.path(tc.VOCABULARY), public_tokenizers.path(tc.RANKS)
PARTS = ["a", " ", "  ", "\n", "'s", "'", "1", "é", "!", "中", "\t", "\xa0", "\x85", "\x1c", "\x0b", "<|endoftext|>", "<|endof", "😀", "ß", "ǅ", "²", "½", "Ⅷ", "—"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_counter_is_the_library(text):
    counter = tc.counter(VOCABULARY, RANKS)
    assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


def test_every_settled_character():
    counter = tc.counter(VOCABULARY, RANKS)
    for cp in [*range(0x237), *range(0x391, 0x3CF), *range(0x410, 0x450), *range(0x2010, 0x2053), *range(0x20A0, 0x20AD), *range(0x3041, 0x30FB), *range(0x4E00, 0x9FA6, 61)]:
        for text in (f"a{chr(cp)}b", f" {chr(cp)}  {chr(cp)}1"):
            assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


def test_query_against_library(spark, sf):
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for d, t in docs}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.op8_token_counts(spark, sf).collect()}
    assert got == want


def test_cache_is_used_and_versioned(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c"), (4, "d e f")], "doc_id long, text string")
    first = sorted(tuple(r) for r in tc.count_documents(df, cache).collect())
    assert first == [(1, 3, 2), (2, 3, 2), (3, 0, 0), (4, 1, 1), (4, 5, 3)]
    assert spark.read.parquet(cache).count() == 4
    more = df.unionByName(spark.createDataFrame([(9, "new words"), (10, "c")], df.schema))
    assert tc.count_documents(more, cache).count() == 7
    assert spark.read.parquet(cache).count() == 5
    # a stored count is taken as it is
    spark.createDataFrame([(b"?", tc.tokenizer_digest(VOCABULARY), 77)], tc.CACHE).write.mode("append").parquet(cache)
    monkeypatch.setattr(tc, "SKIP_ROWS", -1)  # the way beyond the broadcast gives the same rows
    assert sorted(tuple(r) for r in tc.count_documents(df, str(tmp_path / "other")).collect()) == first
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tc.count_documents(df, cache, other, None).count() == 5
    assert {r[0] for r in spark.read.parquet(cache).select("tokenizer").collect()} == {tc.tokenizer_digest(VOCABULARY), tc.tokenizer_digest(other)}


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    out = tc.count_documents(df, str(tmp_path / "cache"))
    assert out.count() == df.count()
    assert tc.count_documents(df.limit(0), str(tmp_path / "none")).count() == 0
    # A second run finds every text in the cache, those without a doc_id too, and adds nothing.
    rows = spark.read.parquet(str(tmp_path / "cache")).count()
    again = tc.count_documents(df, str(tmp_path / "cache"))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == rows


def test_runs_that_the_faster_library_gives_up_on():
    counter = tc.counter(VOCABULARY, RANKS)
    for text in (" " * 1_000_000 + "x", "x" + " " * 2_000_000, "<|endoftext|>" + " " * 1_000_000 + "x"):
        assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)
