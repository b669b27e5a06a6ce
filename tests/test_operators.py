"""Operators on Spark: golden cases, invariants of summaries, grounding, reports and validation."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import backends, compare, ground, metrics, report, retrieve, segment, summarise, validate
from spanloom.operators.embedders import HashingEmbedder


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first()["x"]


#: Summaries, sources, shares and missing numbers that must be matched.
FIDELITY = [
    ("Patient is 29 and got 500 mg.", "A 29-year-old given 500 mg daily.", 1.0, []),
    ("Patient is 42 and got 750 mg.", "A 29-year-old given 500 mg daily.", 0.0, ["42", "750"]),
    ("WBC 10200", "WBC was 10,200 today", 1.0, []),
    ("Seen on May 31, 2023.", "Visit dated 31/05/2023.", 1.0, []),
    ("Recorded 2023.", "dated 31/05/2023", 1.0, []),
    ("The day was 5.", "dated 31/05/2023", 1.0, []),
    ("Diastolic was 80.", "BP was 110/80 mmHg", 1.0, []),
    ("Seen on 31/05/2023.", "Visit dated May 31, 2023.", 1.0, []),
    ("AFP was 21.", "CRP 3.21 mg/dL", 0.0, ["21"]),
    ("Platelets 200.", "WBC was 10,200", 0.0, ["200"]),
    ("Platelets of 230,000/mm3.", "Platelets were normal.", 0.0, ["230,000", "3"]),
    ("Platelets were 25 000 per uL with 50 000 units.", "Platelet count was 25,000 per uL and the dose was 50000 units.", 1.0, []),
    ("Platelets were 99 999 per uL.", "Platelet count was 25,000 per uL.", 0.0, ["99999"]),
    ("none", "none", 1.0, []),
]


@pytest.mark.parametrize(("summary", "source", "share", "missing"), FIDELITY)
def test_numeric_fidelity(spark, summary, source, share, missing):
    got = one(spark, F.struct(metrics.numeric_fidelity(F.col("a"), F.col("b")).alias("s"), metrics.unsupported_numbers(F.col("a"), F.col("b")).alias("m")), a=summary, b=source)
    if summary.startswith("Platelets of"):
        assert "230,000" in got["m"] and got["s"] == 0.0
    else:
        assert got["s"] == share and got["m"] == missing


def test_rouge(spark):
    rows = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a b c", "x y z"), (3, "a b c", "c b a"), (4, "", "a"), (5, "a a b", "a b b"), (6, None, None)], "k long, p string, r string")
    r1 = {r["k"]: r for r in metrics.rouge_n(rows, "k", "p", "r", 1).collect()}
    assert [r1[k]["f1"] for k in (1, 2, 4, 6)] == [1.0, 0.0, 0.0, 0.0] and r1[5]["f1"] == pytest.approx(2 / 3)
    r2 = {r["k"]: r["f1"] for r in metrics.rouge_n(rows, "k", "p", "r", 2).collect()}
    assert r2 == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5, 6: 0.0}
    inside = {r["k"]: r["s"]["f1"] for r in rows.where("k < 6").select("k", metrics.rouge_n_column(F.col("p"), F.col("r"), 2).alias("s")).collect()}
    assert inside == {k: r2[k] for k in inside}
    rl = {r["k"]: r["s"]["f1"] for r in rows.where("k < 6").select("k", metrics.rouge_l(F.col("p"), F.col("r")).alias("s")).collect()}
    assert rl[1] == 1.0 and rl[3] < rl[1] and rl[4] == 0.0


def test_containment_and_artifacts(spark):
    contained = lambda a, b: one(spark, T.containment(T.tokens(F.col("a")), T.tokens(F.col("b"))), a=a, b=b)
    assert contained("x y", "x y") == 1.0 and contained("", "x") == 0.0
    assert contained("given 100 mg", "the patient was given 100 mg orally daily") == 1.0
    assert contained("given 200 mg", "the patient was given 100 mg orally daily") < 1.0
    for said in ("<think>reasoning\nhere</think>The patient improved.", "Here is the summary: The patient improved.", "SUMMARY: The patient improved."):
        assert one(spark, T.strip_artifacts(F.col("a")), a=said) == "The patient improved."


#: A source with quotes that must be found and quotes that must be rejected.
SOURCE = (
    "A 52-year-old female patient presented with anterior neck swelling. She was managed with propylthiouracil 100 mg orally "
    "three times per day. After 2 weeks of steroid treatment the patient improved markedly."
)
FOUND = [
    "managed with propylthiouracil 100 mg orally three times per day", "managed with propylthiouracil\n 100  mg orally three times per day",
    "A 52‑year‑old female patient", "propylthiouracil 100 mg orally",
]
REJECTED = ["treated with amoxicillin 500 mg", "propylthiouracil 250 mg orally", "The spacecraft landed on the moon", "the", "xxxxxxxxxxx"]


def test_quotes(spark):
    rows = [(k, q) for k, q in enumerate(FOUND + REJECTED)]
    quotes = spark.createDataFrame([(1, k, q) for k, q in rows], "doc_id long, k long, quote string")
    chunks = spark.createDataFrame([(1, 0, 0, SOURCE[:68]), (1, 1, 68, SOURCE[68:])], "doc_id long, chunk_ix int, start int, text string")
    out = {r["k"]: r for r in ground.locate_quotes(quotes, chunks, "doc_id").collect()}
    assert [out[k]["chunk_ix"] is not None for k, _ in rows] == [True] * len(FOUND) + [False] * len(REJECTED)
    assert SOURCE[out[0]["start"] : out[0]["end"]] == FOUND[0]
    claims = json.dumps({"claims": [{"claim": q, "quote": q} for _, q in rows]})
    df = spark.createDataFrame([(SOURCE, claims)], "text string, reply string").withColumn("u", F.expr(f"array(named_struct('ix', 0, 'start', 0, 'end', {len(SOURCE)}))"))
    v = df.select(ground.verify(ground.parse_claims(F.col("reply")), F.col("text"), F.col("u")).alias("v")).first()["v"]
    assert (v["quotes_asserted"], v["quotes_verified"]) == (len(rows), len(FOUND)) and v["rejected_quotes"] == REJECTED
    assert [bool(f["sources"]) for f in v["facts"]] == [True] * len(FOUND) + [False] * len(REJECTED)


@pytest.mark.parametrize(
    ("reply", "n"),
    [('{"claims":[{"claim":"a","quote":"b"}]}', 1), ('Sure: {"claims":[{"claim":"a","quote":"b"}]} done', 1), ('[{"claim":"a","quote":"b"}]', 1),
     ('<think>x</think>{"claims":[{"claim":"a"}]}', 1), ("not json at all", 0), ("", 0), ('{"claims":[{"claim":"","quote":"b"}]}', 0), ('x [{"claim":"a"}]', 0)],
)
def test_claims(spark, reply, n):
    assert len(one(spark, ground.parse_claims(F.col("a")), a=reply)) == n


@pytest.mark.parametrize(("value", "seconds"), [("630ms", 0.63), ("2.5s", 2.5), ("1m", 60), ("1m26.4s", 86.4), ("12", 12), ("nonsense", None), (None, None), ("", None)])
def test_durations(spark, value, seconds):
    assert backends.parse_wait(value) == (pytest.approx(seconds) if seconds is not None else None)
    assert one(spark, T.duration_seconds(F.col("a")), a=value) == (pytest.approx(seconds) if seconds is not None else None)


# ---------------------------------------------------------------- summaries


@pytest.fixture(scope="module")
def documents(spark, sf):
    extra = spark.createDataFrame([(-1, ""), (-2, None), (-3, "Short one. Two."), (-4, " ".join(f"This is sentence number {i} about topic {i % 7} of the report." for i in range(900)))], "doc_id long, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra)


def test_extractive_invariants(spark, documents):
    out = summarise.summarise_extractive(documents)
    rows = out.collect()
    assert len(rows) == documents.count()
    for r in rows:
        starts = [f["sources"][0]["start"] for f in r["facts"]]
        assert starts == sorted(starts) and len(starts) <= 15
        for f in r["facts"]:
            s = f["sources"][0]
            assert r["text"][s["start"] : s["end"]] == f["text"] == s["cited_text"]
            chunk = next(c for c in r["chunks_used"] if c["ix"] == s["chunk_ix"])
            assert chunk["start"] <= s["start"] and s["end"] <= chunk["end"]
        assert r["summary"] == " ".join(f["text"] for f in r["facts"])
    scored = metrics.score(out)
    assert scored.where("size(facts) > 0 and (attribution_coverage < 1 or citation_integrity < 1 or numeric_fidelity < 1)").count() == 0
    long = next(r for r in rows if r["doc_id"] == -4)
    assert len(long["chunks_used"]) >= 32
    assert max(len(r["facts"]) for r in summarise.summarise_extractive(documents, length="brief").collect()) == 4


def _twin_bm25(chunks, query, tokenize):
    import math

    docs = [tokenize(c) for c in chunks]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in tokenize(query)) for d in docs]


def test_hybrid_scores_against_a_twin(spark, documents):
    import re

    chunks = segment.chunks(documents.where("doc_id = -4"))
    queries, embedder = ["topic 3 of the report, the number", "sentence 12"], HashingEmbedder(64)
    got = {(r["query_ix"], r["chunk_ix"]): r for r in retrieve.scored(chunks, queries, embedder).collect()}
    texts = [r["text"] for r in chunks.orderBy("chunk_ix").collect()]
    tokenize = lambda t: re.findall(T.TOKEN, t.lower())
    vectors = embedder.encode(texts)
    scale = lambda v: np.zeros(len(v)) if np.ptp(v) < 1e-9 else (v - v.min()) / np.ptp(v)
    for q, query in enumerate(queries):
        dense, sparse = vectors @ embedder.encode([query])[0], np.array(_twin_bm25(texts, query, tokenize))
        blend = 0.65 * scale(dense) + 0.35 * scale(sparse)
        for c in range(len(texts)):
            r = got[q, c]
            assert (r["dense_score"], r["sparse_score"], r["score"]) == pytest.approx((dense[c], sparse[c], blend[c]), abs=1e-9)
    hits = retrieve.search(chunks, queries, 3, embedder).collect()
    assert len(hits) == 6 and {h["rank"] for h in hits} == {1, 2, 3}
    assert retrieve.search_many(chunks, queries, budget=4, embedder=embedder).count() == 4
    # without a budget: what is among the best 32 of any query
    best = {c for q in range(2) for c in sorted(range(len(texts)), key=lambda c, q=q: (-got[q, c]["score"], c))[:32]}
    assert {r["chunk_ix"] for r in retrieve.search_many(chunks, queries, embedder=embedder).collect()} == best


def test_chunks_chosen_in_the_row_are_those_of_the_joined_search(spark, documents):
    """Two ways to one result: kernels inside a row, and joins over chunk rows."""
    for budget in (None, 3):
        df = documents.where("doc_id in (-4, -3, 1, 2, 3)")
        queries = ["topic 3 of the report, the number", "sentence 12"]
        inside = {r["doc_id"]: {c["ix"] for c in r["chunks_used"]} for r in summarise.select_chunks(df, queries, budget=budget).collect()}
        joined = {}
        for r in retrieve.search_many(segment.chunks(df), queries, budget=budget).collect():
            joined.setdefault(r["doc_id"], set()).add(r["chunk_ix"])
        assert {k: v for k, v in inside.items() if v} == joined
    plan = summarise.summarise_extractive(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") <= 3


def test_effective_top_k(spark):
    df = spark.createDataFrame([(3,), (8,), (20,), (5000,)], "n int")
    assert [r[0] for r in df.select(retrieve.effective_top_k(F.col("n"))).collect()] == [8, 8, 20, 32]


def test_segments_on_spark(spark, documents):
    sents, chunks = segment.sentences(documents), segment.chunks(documents)
    assert segment.checked(chunks).where("`end` - `start` <> length(text)").count() == 0
    from spanloom.functions import kernels as k

    want = set()
    for r in documents.collect():
        spans = k.sentence_spans(r["text"] or "")
        want |= {(r["doc_id"], i, o) for i, o in enumerate(k.owners(spans, k.chunk_spans(r["text"] or ""))) if o is not None}
    got = {(r["doc_id"], r["sent_ix"], r["chunk_ix"]) for r in segment.sentences_within(sents, chunks).collect()}
    assert got == want


def test_backends(spark, documents):
    echo = backends.EchoGenerator()
    long = documents.where("doc_id = -4")
    verified = backends.summarise(long, "verified", echo).first()
    assert (verified["usage"]["quotes_asserted"], verified["usage"]["quotes_verified"]) == (4, 3)
    assert verified["usage"]["rejected_quotes"] == [echo.invented] and verified["usage"]["citation_precision"] == 0.75
    local = backends.summarise(long, "local", echo).first()
    assert [bool(f["sources"]) for f in local["facts"]] == [True, True, True, False]
    assert all(s["support"] >= 0.9 for f in local["facts"][:3] for s in f["sources"][:1])
    api = backends.summarise(documents, "api", echo, chunk_budget=4)
    assert metrics.score(api).where("citation_integrity < 1").count() == 0
    assert api.where("doc_id = -4").first()["chunks_used"][0]["ix"] >= 0
    refused = backends.summarise(long, "remote", backends.RefusingGenerator("declined for testing")).first()
    assert refused["refusal"] == "declined for testing" and refused["facts"] == [] and refused["summary"] == ""
    blocks = json.loads(backends.summarise(long, "extractive").select(backends.document_blocks(F.col("text"), F.col("chunks_used"))).first()[0])
    assert len(blocks) >= 32 and blocks[0]["citations"]["enabled"] and blocks[0]["title"].startswith("[")
    with pytest.raises(ValueError):
        backends.summarise(long, "nothing")
    with pytest.raises(ValueError):
        backends.summarise(long, "local")


class Broken:
    def complete(self, prompt):
        raise RuntimeError("no host")


def test_compare(spark, documents):
    few = documents.where("doc_id < 20")
    rows = {r["backend"]: r for r in compare.rollup(compare.compare(few, {"extractive": None, "local": backends.EchoGenerator(), "remote": Broken()})).collect()}
    assert rows["extractive"]["n_docs"] == few.count() and rows["extractive"]["failed"] == 0
    assert rows["remote"]["failed"] > 0 and "no host" in rows["remote"]["error"]
    assert "extractive" in report.format_table([r.asDict() for r in rows.values()], ["backend", "n_docs"])


# ---------------------------------------------------------------- transport


class Server:
    """Answers in turn; remembers payloads."""

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def __call__(self, payload, timeout):
        self.seen.append(dict(payload))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


GOOD = (200, {}, json.dumps({"choices": [{"message": {"content": "hello"}, "finish_reason": "stop"}], "model": "m", "usage": {"prompt_tokens": 5, "completion_tokens": 2}}))
PROMPT = {"task": "t", "excerpts": ["a"], "json": True, "max_tokens": 100}


def _client(*answers):
    naps = []
    server = Server(*answers)
    client = backends.ChatClient(server, pacer=backends.Pacer(clock=lambda: 0.0, sleep=naps.append), jitter=lambda a, b: a)
    return client, server, naps


def test_retries():
    client, server, naps = _client((429, {"retry-after": "0.2"}, ""), (503, {}, ""), OSError("down"), GOOD)
    assert client.complete(PROMPT)["content"] == "hello" and naps == [8.1, 2.0, 4.0]
    for status, kind in ((401, backends.GenerationError), (404, backends.GenerationError)):
        client, server, _ = _client((status, {}, "no"))
        with pytest.raises(kind):
            client.complete(PROMPT)
        assert len(server.seen) == 1
    client, _, _ = _client((429, {"retry-after": "99999"}, "limit on tokens per day (TPD)"))
    with pytest.raises(backends.QuotaExhausted) as e:
        client.complete(PROMPT)
    assert e.value.retry_after == 7200.0
    client, _, naps = _client(*[(500, {}, "")] * 13)
    with pytest.raises(backends.GenerationError):
        client.complete(PROMPT)
    assert len(naps) == 12 and max(naps) == 90.0


def test_truncated_replies_get_more_tokens():
    cut = (400, {}, '{"error": "json_validate_failed"}')
    client, server, _ = _client(cut, GOOD)
    client.complete(PROMPT)
    assert [p["max_tokens"] for p in server.seen] == [100, 200]
    client, _, _ = _client(cut, cut, cut)
    with pytest.raises(backends.Truncated):
        client.complete(PROMPT)


def test_pacing():
    now, naps = [0.0], []
    pacer = backends.Pacer(clock=lambda: now[0], sleep=naps.append)
    assert pacer.wait_for(5000) == 0.0
    pacer.remember({"x-ratelimit-limit-tokens": "6000", "x-ratelimit-remaining-tokens": "1000"})
    assert pacer.wait_for(3000) == pytest.approx(20.0)
    now[0] = 20.0
    assert pacer.wait_for(3000) == 0.0
    assert pacer.wait_for(10**9) == pytest.approx(30.0)


def test_tasks_share_the_rate():
    pacer = backends.Pacer(clock=lambda: 0.0, sleep=lambda s: None)
    client = backends.ChatClient(Server(GOOD), pacer=pacer).shared(4)
    client.pacer.remember({"x-ratelimit-limit-tokens": "6000", "x-ratelimit-remaining-tokens": "0"})
    assert client.pacer.wait_for(100) == pytest.approx(4.0) and pacer.limit == 0


def test_native_blocks_are_sent_and_read():
    answer = json.dumps({"choices": [{"message": {"content": [{"text": "a", "citations": []}, {"text": "b"}]}, "finish_reason": "stop"}]})
    client, server, _ = _client((200, {}, answer))
    reply = client.complete(PROMPT | {"json": False, "documents": json.dumps([{"type": "document"}])})
    assert reply["content"] == "ab" and [b["text"] for b in reply["blocks"]] == ["a", "b"]
    assert [b["type"] for b in server.seen[0]["messages"][0]["content"]] == ["document", "text"]


def test_local_prompts_use_the_model_s_own_template():
    class Tokenizer:
        chat_template = "x"

        def apply_chat_template(self, messages, **how):
            assert how["add_generation_prompt"] and not how["tokenize"]
            return f"<{messages[0]['role']}>{messages[0]['content']}"

    model = backends.LocalModel("nowhere")
    assert model.render(Tokenizer(), PROMPT) == "<user>a\n\nt"
    assert model.render(object(), PROMPT) == "a\n\nt\n\n"


# ---------------------------------------------------------------- reports and validation


def test_reports(spark, documents):
    out = summarise.summarise_extractive(documents.where("doc_id in (-4, -1, 0)"))
    for r in report.to_html(report.to_json(report.to_text(out))).collect():
        data = json.loads(r["json"])
        assert [f["text"] for f in data["facts"]] == [f["text"] for f in r["facts"]]
        for f in data["facts"]:
            s = f["sources"][0]
            assert s["line"] == r["text"].count("\n", 0, s["start"]) + 1
        assert r["report"].count("\n [") == len(r["facts"]) and r["report"].startswith("=" * 88)
        assert r["html"].count("<mark id=") == len({f["sources"][0]["start"] for f in r["facts"]}) or "<mark" in r["html"] or not r["facts"]
        bare = r["html"].split('<article class="source">')[1].split("</article>")[0]
        import html
        import re

        assert html.unescape(re.sub("<[^>]+>", "", bare.replace("<br>", "\n"))) == (r["text"] or "")


def test_merged_spans(spark):
    rows = [(1, 0, 5), (1, 5, 9), (1, 3, 4), (1, 11, 12), (1, 20, 30), (1, 21, 22), (2, 4, 8)]
    df = spark.createDataFrame(rows, "d long, start int, `end` int")
    got = sorted(tuple(r) for r in report.merge_spans(df, "d").collect())
    assert got == [(1, 0, 0, 9, 3), (1, 1, 11, 12, 1), (1, 2, 20, 30, 2), (2, 0, 4, 8, 1)]
    inside = df.groupBy("d").agg(report.merged_array(F.collect_list(F.struct("start", "end"))).alias("m"))
    assert {r["d"]: [tuple(x) for x in r["m"]] for r in inside.collect()} == {1: [(0, 9), (11, 12), (20, 30)], 2: [(4, 8)]}


def test_rank_correlation(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    table = pd.DataFrame({"k": range(300), "a": rng.integers(0, 20, 300).astype(float), "b": rng.normal(size=300).round(1)})
    table["c"] = table.a + rng.normal(size=300)
    got = validate.correlations(spark.createDataFrame(table), ["a"], ["b", "c"], "k")
    ranks = table.rank()
    assert [g["rho"] for g in got] == pytest.approx([ranks.a.corr(ranks.b), ranks.a.corr(ranks.c)])
    assert got[1]["p"] < 1e-6 < got[0]["p"] <= 1


@pytest.mark.parametrize(("rho", "n", "p"), [(-0.367, 33, 0.0357), (0.5, 10, 0.1411), (0.0, 50, 1.0), (0.117, 400, 0.0192)])
def test_p_values(rho, n, p):
    assert validate.p_value(rho, n) == pytest.approx(p, abs=6e-4)


def test_cosine_topk_answers_more_queries_than_a_block(spark, monkeypatch):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)] + [(None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(str, retrieve.cosine_topk(df, df, "vec_id", "embedding", 4).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 10)
    got = sorted(map(str, retrieve.cosine_topk(df, df, "vec_id", "embedding", 4).collect()))
    assert got == want and len(got) == 61 * 4
    many = spark.range(10_001).selectExpr("id as vec_id", "array(1.0D, cast(id % 3 as double)) as embedding")
    monkeypatch.undo()
    assert retrieve.cosine_topk(many.where("vec_id < 5"), many, "vec_id", "embedding", 1).count() == 10_001


def test_a_score_at_the_threshold_supports_its_claim():
    """Scores that are 0.45 in exact numbers; one of them is a little less as a sum of doubles."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    pool = [(" ".join(words), 0, 0, 60)]
    for shared, length in ((1, 2), (2, 4)):
        claim = " ".join(words[:shared] + [f"other{n}" for n in range(length - shared)])

        class Stand:
            def encode(self, texts):
                return np.array([[1.0, 0.0] if t == claim else [0.39999999999999997, 0.916515138991168] for t in texts])

        assert 0.5 * 0.39999999999999997 + 0.5 * shared / length < 0.45
        assert [s["support"] for s in ground._supports([claim], pool, Stand())[0]] == [0.45]


def test_cosine_topk_sums_only_candidates_and_ranks_odd_vectors(spark):
    """Every hit is that of brute force: copies, nulls, other lengths, no numbers; few pairs are summed one by one."""
    rng = np.random.default_rng(3)
    rows = [(k, [0.1, 0.3, 0.2] if k % 3 == 0 else rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(120)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, 2.0]), (203, [float("nan"), 0.0, 1.0]), (204, [float("inf"), 0.0, 1.0]), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        return None if a is None or b is None or len(a) != len(b) or None in a or None in b else sum((x * y for x, y in zip(a, b, strict=True)), 0.0)

    worth = lambda c: (c is None, 0 if c is None else c == c, 0 if c is None or c != c else -c)  # noqa: E731  no number is above all, null below
    want = {(q, h, r + 1) for q, a in rows for r, (h, _) in enumerate(sorted(((h, cosine(a, b)) for h, b in rows), key=lambda x: (*worth(x[1]), x[0]))[:5])}
    got = retrieve.cosine_topk(df, df, "vec_id", "embedding", 5).collect()
    assert {(r.query_id, r.hit_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_cosine_topk_hands_on_few_rows_of_many_pairs(spark):
    vectors = np.random.default_rng(4).normal(size=(3000, 8))
    plan = retrieve.cosine_topk(*[spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "k long, v array<double>")] * 2, "k", "v", 3)
    assert "NestedLoopJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    nearest = np.argsort(-(vectors @ vectors.T), axis=1, kind="stable")[:, :3]
    assert {(r.query_id, r.hit_id, r["rank"]) for r in plan.collect()} == {(q, int(h), n + 1) for q, hs in enumerate(nearest) for n, h in enumerate(hs)}


def test_rows_are_searched_without_a_shuffle_as_joins_search_them(spark, documents):
    from spanloom.functions import kernels

    queries = ["topic 3 of the report, the number", "sentence 12"]
    rows = lambda df, *c: sorted((*[r[k] for k in c], None if r["score"] is None else round(r["score"], 9)) for r in df.collect())
    key = ("doc_id", "query_ix", "chunk_ix", "rank")
    chunks = segment.chunks(documents)
    inside = retrieve.search_rows(documents, kernels.chunk_spans, queries, 3)
    assert rows(inside, *key) == rows(retrieve.search(chunks, queries, 3), *key)
    sparse = retrieve.top(retrieve.bm25(chunks, queries).withColumnRenamed("sparse_score", "score"), 3)
    assert rows(retrieve.search_rows(documents, kernels.chunk_spans, queries, 3, dense=False), *key) == rows(sparse, *key)
    for budget in (None, 4):
        many = retrieve.search_many_rows(documents, kernels.chunk_spans, queries, budget=budget)
        joined = {(d, c) for d, c, _ in rows(retrieve.search_many(chunks, queries, budget=budget), "doc_id", "chunk_ix")}
        assert {(d, c) for d, c, _ in rows(many, "doc_id", "chunk_ix")} == joined
        assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_topk", "retrieved_chunks"])
def test_retrieval_queries_shuffle_nothing(spark, sf, name):
    from spanloom.plans import queries

    assert "Exchange" not in queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_summary_is_one_pass_and_small_batches(spark, documents):
    """Each pass is another worker that holds a batch of texts."""
    out = summarise.summarise_extractive(documents)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("Scan ")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 64
    apart = summarise.summarise_extractive(documents, chosen=summarise.select_chunks(documents.select("doc_id", "text"), summarise.aspect_queries("generic")))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(out) == rows(apart.select(out.columns))


def test_a_reply_of_other_types_is_an_error_of_its_document():
    first, second = backends._replies([{"content": "a", "more": 1}, {"content": 3}]).to_pylist()
    assert first["content"] == "a" and first["error"] is None
    assert second["content"] is None and second["error"]


def test_the_stand_in_splits_no_more_excerpts_than_it_says(monkeypatch):
    split = []
    monkeypatch.setattr(backends.kernels, "sentence_spans", lambda text: split.append(text) or [(0, len(text))])
    reply = backends.EchoGenerator(sentences=2).complete({"excerpts": ["One.", "Two.", "Three."], "json": False})
    assert split == ["One.", "Two."] and reply["content"].startswith("One. Two.")


class Odd:
    """Replies of many kinds, by their prompt: prose, JSON in several forms, citations, refusals, errors and wrong types."""

    def complete(self, prompt):
        said = prompt["excerpts"][0]
        first, kind = said[:120], len(said) % 12
        number = "It cost 1,234 or 01/02 and 25 000 and ٣٤."
        reply = {"content": [first, f"<think>x</think>Here is it:  {first} {number}\x1c", f"SUMMARY: {number}", ""][kind % 4], "stop_reason": "stop"}
        if prompt["json"]:
            pair = json.dumps({"claims": [{"claim": first, "quote": first}, {"claim": number, "quote": number}, {"claim": "", "quote": "x"}]})
            forms = [pair, f"Sure: {pair} done", json.dumps([{"claim": first, "quote": "  " + first.replace(" ", "\n\t")}]), '{"claims":[{"claim":5,"quote":null}]}',
                     '{"claims":[{"claim":"a","quote":"b","claim":"c"}]}', "{'claims':[{'claim':'a b c d e','quote':'f'}]}", '{"claims": 3}', "not json", '{"claims":[{"claim":"\\ud800","quote":"q"}]}']
            reply["content"] = forms[kind % 9]
        good = {"type": "char_location", "cited_text": said[2:30], "document_index": 0, "start_char_index": 2, "end_char_index": 30}
        wrong = [{"cited_text": "other"}, {"document_index": 99}, {"document_index": None}, {"start_char_index": -5000}, {"end_char_index": 10**6}, {"end_char_index": 1},
                 {"start_char_index": None}, {"cited_text": None}, {"type": "page"}, {"type": None}, {"cited_text": said[2:30].replace(" ", "  ")}]
        reply["blocks"] = [{"text": f"{first}　", "citations": [good, good | wrong[len(said) % 11]]}, {"text": number, "citations": None}, {"text": "", "citations": [good]}, None]
        if kind == 5:
            return {"content": "no", "stop_reason": "refusal"}
        if kind == 6:
            raise RuntimeError("down")
        return reply | [{}, {"content": 3}, {"blocks": "b"}, {"input_tokens": 2.0}, {"model": None, "more": 1}, {"blocks": None}, {}][len(said) % 7]


ODD_TEXTS = [
    "", None, "  \n", "Es waren 25 000 Stück und 01/02 am Tag, dazu ٣٤ weitere in der Liste. Noch ein Satz steht hier, der lang genug für alles ist.",
    "A “quoted” line — with 1,234 dashes and 3.5 parts stands here for long. B\u0085C comes\x1cafter it, and the text goes on for some more words.",
] + [f"{'x' * n} stands first here, then come words enough to make this a candidate of {n} letters. It cost 1234 in the year {n}, they say, and more was not found. Short one." for n in range(25)]


def test_backends_compared_in_one_pass_score_as_they_do_apart(spark, documents):
    docs = documents.where("doc_id < 60").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string"))
    docs = docs.withColumn("ref", F.expr("if(doc_id % 3 = 0, null, left(text, 200))"))
    for generator in (Odd(), backends.EchoGenerator()):
        kinds = {"extractive": None} | dict.fromkeys(("api", "local", "remote", "verified"), generator)
        for reference in (None, "ref"):
            got = compare.compare(docs, kinds, reference=reference)
            want = set()
            for name in kinds:
                out = backends.summarise(docs, name, kinds[name]).join(docs.select("doc_id", "ref"), "doc_id")
                out = metrics.score(out, reference).withColumn("failed", F.col("error").isNotNull() | F.col("refusal").isNotNull())
                want |= {repr(tuple(r)) for r in out.select(F.lit(name), "doc_id", *metrics.SCORES, "failed", F.coalesce("error", "refusal")).collect()}
            assert got.columns == ["backend", "doc_id", *metrics.SCORES, "failed", "error"]
            rows = [repr(tuple(r)) for r in got.collect()]
            assert set(rows) == want and len(rows) == 5 * docs.count()


class Counted:
    """The stand-in, with a line in a file for each time that it is asked."""

    def __init__(self, path):
        self.path, self.echo = path, backends.EchoGenerator()

    def complete(self, prompt):
        with open(self.path, "a") as f:
            f.write("asked\n")
        return self.echo.complete(prompt)


def test_a_comparison_asks_once_and_reads_a_text_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id between 0 and 19")
    kinds = {"extractive": None} | dict.fromkeys(("api", "local", "remote", "verified"), Counted(str(tmp_path / "asked")))
    out = compare.rollup(compare.compare(docs, kinds))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and "InMemoryTableScan" not in plan
    assert {r["n_docs"] for r in out.collect()} == {docs.count()}
    n = docs.where("text rlike '(?U)\\\\S'").count()
    assert (tmp_path / "asked").read_text().count("asked") == 4 * n


def test_a_backend_without_a_success_has_no_means(spark, documents):
    row = compare.rollup(compare.compare(documents.where("doc_id between 0 and 3"), {"remote": Broken()})).first()
    assert row["failed"] == 4 and row["n_docs"] is None and row["n_claims"] is None and "no host" in row["error"]


def test_plain_replies_are_read_as_the_engine_reads_them(spark):
    replies = [
        '{"claims":[{"claim":"a","quote":"b"},{"claim":"","quote":"b"}]}', '<think>x</think> {"claims": [{"claim": "a\\u00e9\\n", "quote": ""}]} ', '{"claims":[]}',
        '{"claims":[{"quote":"b","claim":"a"}]}', '{"claims":[{"claim":"a","quote":"b"}],"x":1}', '{"claims":[{"claim":"a","claim":"c","quote":"b"}]}', '{"claims":{}}',
        '[{"claim":"a","quote":"b"}]', '{"claims":[{"claim":null,"quote":"b"}]}', '{"claims":[{"claim":"\\ud800","quote":"b"}]}', "{", "{}", "", '{"claims":[1]}', '{"claims":[[["claim","a"],["quote","b"]]]}',
    ]
    read = spark.createDataFrame([(r,) for r in replies], "r string").select("r", ground.parse_claims(F.col("r")).alias("c")).collect()
    plain = {r: ground.plain_claims(r) for r in replies}
    assert [plain[r] is not None for r in replies] == [True] * 3 + [False] * 12
    assert all(plain[r["r"]] is None or plain[r["r"]] == [c.asDict() for c in r["c"]] for r in read)


def test_words_are_placed_as_a_pattern_places_them():
    import re

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab \n\x1c ."), 30)) for _ in range(300)]
    for text, other in zip(texts, texts[1:], strict=False):
        for words in (text[5:11].split(), other[:4].split()):
            if words:
                m = re.search(r"\s+".join(map(re.escape, words)), text)
                assert ground._place(words, text) == (m.span() if m else None)


def test_texts_in_python_are_read_as_columns_read_them(spark):
    from spanloom.functions import plain

    rng = np.random.default_rng(6)
    chars = list("aB0 17,./\n\t\x1c    　\u0085 ٣é_-:<>") + ["Summary:", "here is x:", "<think>", "</think>"]
    texts = ["".join(rng.choice(chars, int(n))) for n in rng.integers(0, 25, 600)] + ["ſUMMARY: x", "HERE'S y: z", "a \n", "007/0/x/12,000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    forms = F.transform(T.numbers(t), T.numeric_forms)
    for r in df.select("t", T.strip(t).alias("strip"), T.squeeze(t).alias("squeeze"), T.is_claim_like(t).alias("claim"), T.strip_artifacts(t).alias("bare"), T.numbers(t).alias("numbers"), forms.alias("forms")).collect():
        s = r["t"]
        assert (plain.strip(s), plain.squeeze(s), plain.is_claim_like(s), plain.strip_artifacts(s), plain.numbers(s)) == (r["strip"], r["squeeze"], r["claim"], r["bare"], r["numbers"])
        assert [plain.numeric_forms(n) for n in plain.numbers(s)] == [set(f) for f in r["forms"]]


def test_tokens_without_decimals_are_parted_by_other_characters():
    import re

    from spanloom.operators.embedders import token_list

    rng = np.random.default_rng(7)
    for n in rng.integers(0, 20, 500):
        text = "".join(rng.choice(list("aZ09. éKİ-_\n٣"), int(n)))
        assert token_list(text) == re.findall(T.TOKEN, text.lower())


def test_blocks_of_a_text_are_those_of_the_column(spark):
    text, chunks = 'One "line"\né  and more.', [{"ix": 0, "start": 0, "end": 12}, {"ix": 3, "start": 5, "end": 20}]
    df = spark.createDataFrame([(text, chunks)], f"t string, c {summarise.CHUNKS}")
    assert df.select(backends.document_blocks(F.col("t"), F.col("c"))).first()[0] == backends.block_json(text, chunks)
