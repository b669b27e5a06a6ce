import hashlib
import re

from pyspark.sql import functions as F

from spanloom.llm import fingerprints as fp
from tests.llm.helpers import awkward


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def _check(spark, df):
    rows = [tuple(r) for r in df.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]), reverse=True)
    rows = [r[:2] for r in rows]
    texts = [t for _, t in rows]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, following, strict=True)]
    got = fp.fingerprint_documents(df).collect()
    key = lambda d, n, s: (str(d), n, s)
    want = sorted(key(d, len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, t), e in zip(rows, edited, strict=True))
    assert sorted(key(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    return rows, edited, following, got


def test_edits_and_estimates(spark, sf):
    rows, edited, following, got = _check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    by = {r["doc_id"]: r for r in got}
    errors = [by[d]["near_edited"] - jaccard(t, e) for (d, t), e in zip(rows, edited, strict=True)]
    errors += [by[d]["near_next"] - jaccard(t, n) for (d, t), n in zip(rows, following, strict=True)]
    assert max(map(abs, errors)) < 0.15
    assert abs(sum(errors) / len(errors)) < 0.01
    prints = {}
    for d, t in rows:
        assert prints.setdefault(t, by[d]["fingerprint"]) == by[d]["fingerprint"]
    assert len(set(prints.values())) > 0.95 * len(prints)


def test_many_ranges_hold_the_order(spark, sf, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 3)
    monkeypatch.setattr(fp, "MAX_LIMITS", 7)
    _check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def plain_signature(hashes):
    """One permutation, densification and low bits, bin by bin from the definition."""
    mins = {}
    for h in hashes:
        b = (h % 2**64) >> 56
        mins[b] = min(h, mins.get(b, h))
    out = []
    for probes in enumerate(fp._probe_table(fp.BINS)):
        j, order = probes
        b = next(b for b in [j, *order] if b in mins)
        out.append((mins[b] & 255) - 128)
    return out


def test_signatures_against_a_plain_twin(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60)
    got = fp.with_signature(df, "text", "s").select("text", "s").collect()
    for text, signature in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = sorted({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
        if not words:
            assert signature is None
            continue
        rows = spark.createDataFrame([tuple([*g, *[None] * (5 - len(g))]) for g in grams], "a string, b string, c string, d string, e string")
        hashes = [r[0] for r in rows.select(F.xxhash64("a", "b", "c", "d", "e")).collect()]
        assert signature == plain_signature(hashes)


def test_a_common_id_is_spread(spark, monkeypatch):
    """One doc_id, or none, for most rows: no range holds more than its share, and the order stays whole."""
    monkeypatch.setattr(fp, "RANGE_ROWS", 20)
    rows = [(7 if k % 3 else None, f"text number {k} of many") for k in range(900)] + [(k, f"other {k}") for k in range(60)] + [(2**63 - 1, "top"), (-(2**63), "bottom")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fp._ranges(df).groupBy(*fp.RANGE).count().agg(F.max("count")).first()[0] <= 60
    _check(spark, df)
    every = df.where("doc_id = 7")
    assert fp._ranges(every).groupBy(*fp.RANGE).count().agg(F.max("count")).first()[0] <= 60
    _check(spark, every)


def test_clustered_ids_are_split_twice(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    monkeypatch.setattr(fp, "MAX_LIMITS", 8)
    df = spark.createDataFrame([(2**k // 7, f"text {k} {j}") for k in range(55) for j in range(3)], "doc_id long, text string")
    assert fp._ranges(df).groupBy(*fp.RANGE).count().agg(F.max("count")).first()[0] <= 30
    _check(spark, df)


def test_awkward_rows(spark):
    df = awkward(spark)
    _check(spark, df)
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    one = fp.fingerprint_documents(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    blank = fp.fingerprint_documents(df.where("doc_id = 1 or doc_id = 4")).collect()
    assert {r["fingerprint"] for r in blank} == {""} and {r["near_next"] for r in blank} == {1.0}


def test_every_empty_bin_borrows(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, " ".join(map(str, range(40))))], "doc_id long, text string")
    for r in fp.with_signature(df, "text", "s").select("s").collect():
        assert len(r["s"]) == fp.BINS and None not in r["s"]


def test_native(spark, sf):
    plan = fp.op5_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert F is not None
