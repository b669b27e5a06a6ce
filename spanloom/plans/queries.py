"""Queries over the driver tables, one for each operator group, and the DuckDB SQL of those that have one.

Every query reads its whole tables. Scores are rounded where two engines may add doubles in
different orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ABBREVIATIONS, ASPECTS, SETTINGS
from ..functions import kernels
from ..functions import text as T
from ..operators import backends, compare, ground, metrics, report, retrieve, segment, summarise, validate
from ..operators.embedders import HashingEmbedder
from ..sources.tables import table
from . import summary_sql as S

QUERIES = ASPECTS["generic"]
#: Dimensions of the stand-in embedder where a query sets none.
DIMS = HashingEmbedder().dims


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _digest(text: str) -> F.Column:
    return F.md5(F.col(text))


# ---------------------------------------------------------------- segmentation


def token_stats(spark, sf_dir):
    toks = T.tokens(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"))


def sentences(spark, sf_dir):
    rows = segment.sentences(_docs(spark, sf_dir))
    return rows.select("doc_id", F.col("sent_ix").cast("long"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), _digest("text").alias("digest"))


def paragraphs(spark, sf_dir):
    rows = segment.paragraphs(_docs(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_ix").cast("long"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), _digest("text").alias("digest"))


def chunks(spark, sf_dir):
    rows = segment.with_titles(segment.checked(segment.chunks(_docs(spark, sf_dir))))
    return rows.select("doc_id", F.col("chunk_ix").cast("long"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "title", _digest("text").alias("digest"))


def chunk_windows(spark, sf_dir):
    rows = segment.windows(segment.chunks(_docs(spark, sf_dir)), 4)
    counts = rows.groupBy("doc_id", F.col("window_ix").cast("long").alias("window_ix"))
    return counts.agg(F.count("*").alias("n_chunks"), F.min("start").cast("long").alias("start_at"), F.max("end").cast("long").alias("end_at"))


def chunk_integrity(spark, sf_dir):
    """For each document with text: chunks that are not their slice, are too long, or leave text between them."""
    df = _docs(spark, sf_dir).withColumn("c", segment.chunk_array(F.col("text"))).where(F.size("c") > 0)
    slice_ = lambda a, b: T.cut(F.col("text"), a, b)
    trimmed = lambda c: slice_(c["start"], c["end"])
    bad = F.size(F.filter("c", lambda c: (F.length(trimmed(c)) != c["end"] - c["start"]) | (T.strip(trimmed(c)) != trimmed(c))))
    long_ = F.size(F.filter("c", lambda c: c["end"] - c["start"] > 2400))
    gaps = F.size(F.filter("c", lambda c, k: (k > 0) & T.strip(slice_(F.get("c", k - 1)["end"], c["start"])).rlike("(?U)\\S")))
    return df.select(
        "doc_id", bad.cast("long").alias("n_wrong"), long_.cast("long").alias("n_too_long"), gaps.cast("long").alias("n_gaps"),
        F.get("c", F.lit(0))["start"].cast("long").alias("first_start"), F.element_at("c", -1)["end"].cast("long").alias("last_end"),
    )


def sentences_within(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = segment.sentences_within(segment.sentences(docs), segment.chunks(docs), SETTINGS.min_sentence)
    return rows.select("doc_id", F.col("sent_ix").cast("long"), F.col("chunk_ix").cast("long"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


# ---------------------------------------------------------------- retrieval


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id", F.col("query_ix").cast("long"), F.col("chunk_ix").cast("long"), F.col("rank").cast("long"), F.round("score", 7).alias("score")
    )


def bm25_topk(spark, sf_dir):
    """Sentences as the units that are ranked."""
    return _ranked(retrieve.search_rows(_docs(spark, sf_dir), kernels.sentence_spans, QUERIES, 3, dense=False))


def hybrid_topk(spark, sf_dir):
    return _ranked(retrieve.search_rows(_docs(spark, sf_dir), kernels.sentence_spans, QUERIES, 3, HashingEmbedder(64)))


def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = retrieve.cosine_topk(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return hits.select("query_id", "hit_id", F.col("rank").cast("long"), F.round("cosine", 6).alias("cosine"))


def retrieved_chunks(spark, sf_dir):
    hits = retrieve.search_many_rows(_docs(spark, sf_dir), kernels.chunk_spans, QUERIES, budget=4)
    return hits.select("doc_id", F.col("chunk_ix").cast("long"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- summaries and grounding


def extractive_summary(spark, sf_dir):
    """Each summary, how many facts it has, and where each stands: chunk, start and end."""
    out = summarise.summarise_extractive(_docs(spark, sf_dir))
    source = lambda f: F.concat_ws(":", F.get(f["sources"], F.lit(0))["chunk_ix"], F.get(f["sources"], F.lit(0))["start"], F.get(f["sources"], F.lit(0))["end"])
    return out.select("doc_id", "summary", F.size("facts").cast("long").alias("n_facts"), F.array_join(F.transform("facts", source), ",").alias("spans"), "stop_reason")


def summary_scores(spark, sf_dir):
    scored = metrics.score(summarise.summarise_extractive(_docs(spark, sf_dir)))
    return scored.select("doc_id", "attribution_coverage", "citation_integrity", "numeric_fidelity", F.col("invalid_citations").cast("long"))


def quote_verify(spark, sf_dir):
    """Every benchmark passage against every document: where it stands, white space and typography aside.

    The passages are a stated query set. Words inside a passage must stand whole in a document, so five
    of them are looked up by hash among the document's own windows; only documents that have them are
    searched for the passage. Passages of under seven words are looked for in every text.
    """
    quotes = table(spark, sf_dir, "benchmark").select("item_id", T.fold_typography(F.col("text")).alias("quote"))
    quotes = quotes.where(F.length(T.strip(F.col("quote"))) >= 12).withColumn("w", T.word_list(F.col("quote")))
    quotes = quotes.select("item_id", "quote", T.squeeze(F.col("quote")).alias("squeezed_quote"), "w")
    key = F.when(F.size("w") >= 7, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(1, 6)]))
    quotes = quotes.withColumn("key", key).drop("w")
    n, n_short = quotes.count(), quotes.where("key is null").count()
    few = (lambda df: F.broadcast(df)) if n <= 10_000 else (lambda df: df)
    docs = _docs(spark, sf_dir)
    words = docs.select("doc_id", T.word_list(T.fold_typography(F.col("text"))).alias("w"))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    keys = words.select("doc_id", F.explode(hashes).alias("key"))
    pairs = keys.join(few(quotes.where("key is not null").select("key", "item_id")), "key").select("doc_id", "item_id").distinct()
    if n_short:
        short = few(quotes.where("key is null").select("item_id", "squeezed_quote"))
        there = F.contains(F.col("squeezed"), F.col("squeezed_quote"))
        squeezed = docs.select("doc_id", T.squeeze(T.fold_typography(F.col("text"))).alias("squeezed"))
        pairs = pairs.unionByName(squeezed.join(short, there).select("doc_id", "item_id"))
    # What is found by words or by containment is checked, and placed, by the library's own search, the text as one chunk.
    asked = pairs.join(few(quotes.select("item_id", "quote")), "item_id")
    shown = docs.select("doc_id", F.lit(0).alias("chunk_ix"), F.lit(0).alias("start"), "text")
    found = ground.locate_quotes(asked, shown, "doc_id").where("chunk_ix is not null")
    return found.select("item_id", "doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


def _pairs(spark, sf_dir) -> DataFrame:
    """(pair_id, said, asked): assistant turns with the turn before them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("said"))
    asked = turns.select(F.col("conv_id"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    pairs = said.join(asked, ["conv_id", "turn"])
    return pairs.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("pair_id"), "said", "asked")


def _rouge(n):
    def query(spark, sf_dir):
        out = metrics.rouge_n(_pairs(spark, sf_dir), "pair_id", "said", "asked", n)
        return out.select("pair_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])

    return query


def rouge_l(spark, sf_dir):
    s = metrics.rouge_l(F.col("said"), F.col("asked"))
    return _pairs(spark, sf_dir).withColumn("s", s).select("pair_id", *[F.round(F.col(f"s.{c}"), 9).alias(c) for c in ("precision", "recall", "f1")])


def containment_align(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    claims = turns.where("role = 'assistant'").withColumnRenamed("turn", "claim_ix")
    sources = turns.where("role = 'user'").withColumnRenamed("turn", "source_ix")
    out = ground.aligned(claims, sources, "conv_id")
    return out.select("conv_id", "claim_ix", "source_ix", F.col("rank").cast("long"), F.round("containment", 9).alias("containment"))


def numeric_fidelity(spark, sf_dir):
    """The numbers of each document against those of the document with the next doc_id."""
    docs = _docs(spark, sf_dir)
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("source"))
    both = docs.join(other, "doc_id")
    a, b = F.col("text"), F.col("source")
    return both.select(
        "doc_id", F.size(T.numbers(a)).cast("long").alias("n_numbers"), F.size(metrics.unsupported_numbers(a, b)).cast("long").alias("n_missing"),
        F.round(metrics.numeric_fidelity(a, b), 9).alias("fidelity"),
    )


def coverage(spark, sf_dir):
    """Attribution coverage where each line is a fact, with a source if it is claim-like."""
    none = F.array().cast("array<int>")
    fact = lambda x: F.struct(x.alias("text"), F.when(T.is_claim_like(x), F.array(F.lit(1))).otherwise(none).alias("sources"))
    facts = F.transform(F.split("text", "\n"), fact)
    return _docs(spark, sf_dir).select("doc_id", F.round(metrics.coverage(facts), 9).alias("coverage"))


def span_merge(spark, sf_dir):
    """Sentences, each with the character after it, merged where they touch."""
    spans = segment.sentences(_docs(spark, sf_dir)).select("doc_id", "start", (F.col("end") + 1).alias("end"))
    out = report.merge_spans(spans, "doc_id")
    return out.select("doc_id", F.col("slot").cast("long"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "n_spans")


def verified_claims(spark, sf_dir):
    out = backends.summarise(_docs(spark, sf_dir), "verified", backends.EchoGenerator())
    count = lambda c: F.col(f"usage.{c}").cast("long").alias(c)
    return out.select("doc_id", count("quotes_asserted"), count("quotes_verified"), "usage.citation_precision", F.size("facts").cast("long").alias("n_facts"))


def native_citations(spark, sf_dir):
    out = backends.summarise(_docs(spark, sf_dir), "api", backends.EchoGenerator(invent=False))
    said = F.md5(F.array_join(F.transform("facts", lambda f: F.concat_ws(":", f["text"], F.get(f["sources"], F.lit(0))["start"], F.get(f["sources"], F.lit(0))["end"])), "|"))
    return out.select("doc_id", F.size("facts").cast("long").alias("n_facts"), metrics.citation_integrity(F.col("facts"), F.col("text")).alias("integrity"), said.alias("said"))


def grounded_prose(spark, sf_dir):
    out = backends.summarise(_docs(spark, sf_dir), "local", backends.EchoGenerator())
    return out.select("doc_id", F.size("facts").cast("long").alias("n_facts"), F.round(metrics.coverage(F.col("facts")), 4).alias("coverage"))


def compare_backends(spark, sf_dir):
    echo = backends.EchoGenerator()
    kinds = {"extractive": None, "api": echo, "local": echo, "remote": echo, "verified": echo}
    return compare.rollup(compare.compare(_docs(spark, sf_dir), kinds))


def _report(render, column):
    def query(spark, sf_dir):
        out = render(summarise.summarise_extractive(_docs(spark, sf_dir)))
        return out.select("doc_id", F.length(column).cast("long").alias("n_chars"), F.md5(column).alias("digest"))

    return query


# ---------------------------------------------------------------- validation and scalar functions


def label_discrimination(spark, sf_dir):
    out = validate.label_discrimination(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "min", "max", "zero_share")])


def spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    ranks = validate.average_ranks(rows, ["n_chars", "quality", "toxic"], "doc_id")
    pair = lambda a, b: F.round(validate.correlation(f"rank_{a}", f"rank_{b}"), 9).alias(f"{a}_{b}")
    return ranks.agg(F.count("*").alias("n"), pair("n_chars", "quality"), pair("n_chars", "toxic"), pair("quality", "toxic"))


def block_means(spark, sf_dir):
    out = validate.block_means(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", ["n_chars"])
    return out.select("block", "n", F.round("n_chars", 9).alias("n_chars"))


def claims_json(spark, sf_dir):
    """Replies that carry a turn as claim and its beginning as quote, in three of the forms that models use, read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    claims = F.array(F.struct(F.col("text").alias("claim"), F.left("text", F.lit(40)).alias("quote")), F.struct(F.lit("").alias("claim"), F.lit("none").alias("quote")))
    whole = F.to_json(F.struct(claims.alias("claims")))
    reply = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, F.to_json(claims)).otherwise(F.concat(F.lit("Sure: "), whole, F.lit(" done")))
    found = turns.select("conv_id", "turn", F.explode(ground.parse_claims(reply)).alias("c"))
    return found.select("conv_id", "turn", F.md5("c.claim").alias("claim"), F.md5("c.quote").alias("quote"))


def tag_strip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("bare", T.strip_tags(F.col("html")))
    return pages.select("page_id", F.length("bare").cast("long").alias("n_chars"), F.md5("bare").alias("digest"))


def text_functions(spark, sf_dir):
    """Escaping, typographic folding, line numbers, numbers and titles on whole documents."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(T.html_escape(t)).alias("escaped"), F.md5(T.fold_typography(t)).alias("folded"),
        T.line_of(t, F.length(t)).cast("long").alias("last_line"), F.md5(T.squeeze(t)).alias("squeezed"),
        F.array_join(T.numbers(t), " ").alias("numbers"), T.is_claim_like(t).alias("claim_like"), F.md5(T.shorten(t, 88, 85)).alias("short"),
    )


WS = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ABBREVIATED = "|".join(sorted(ABBREVIATIONS))

#: Pieces that end at each candidate boundary, flags, and islands between true boundaries.
SENTENCES = rf"""
pieces AS (
  SELECT doc_id, text, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
  FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?[.!?]["'')\]]*{WS}+|.+') AS ps FROM documents WHERE text IS NOT NULL)),
flags AS (
  SELECT *, lower(regexp_extract(piece, '([\p{{L}}\p{{N}}.]*)[.!?]["'')\]]*{WS}+$', 1)) AS run,
         regexp_matches(piece, '[.!?]["'')\]]*{WS}+$') AS candidate,
         sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop,
         length(regexp_extract(piece, '{WS}+$')) AS gap, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM pieces),
cuts AS (
  SELECT *, (candidate AND NOT contains(run, '.') AND NOT regexp_full_match(run, '(?:{_ABBREVIATED}|\p{{L}}|\p{{Nd}}{{1,2}})')
            AND NOT regexp_matches(coalesce(nxt, ''), '^\p{{Ll}}'))::INT AS boundary
  FROM flags),
islands AS (
  SELECT *, coalesce(sum(boundary) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM cuts),
raw AS (
  SELECT doc_id, any_value(text) AS text, island, min(stop - length(piece)) AS a, max(stop) - arg_max(CASE WHEN boundary = 1 THEN gap ELSE 0 END, i) AS b
  FROM islands GROUP BY doc_id, island),
stripped AS (
  SELECT doc_id, island, a + length(regexp_extract(substr(text, a + 1, b - a), '^{WS}+')) AS start_at,
         b - length(regexp_extract(substr(text, a + 1, b - a), '{WS}+$')) AS end_at, text FROM raw),
sentences AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS sent_ix, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at,
         substr(text, start_at + 1, end_at - start_at) AS body FROM stripped WHERE end_at > start_at)
"""
_TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)?')"
_ASKED = ", ".join(f"({k}, '{q}')" for k, q in enumerate(QUERIES))



def _bm25(units: str) -> str:
    """BM25 over the units of each document: (doc_id, chunk_ix, body)."""
    return rf"""
toks AS (SELECT doc_id, chunk_ix, {_TOKENS.format("body")} AS t FROM {units}),
sizes AS (SELECT doc_id, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY doc_id),
tf AS (SELECT doc_id, chunk_ix, dl, term, count(*) AS tf FROM (SELECT doc_id, chunk_ix, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT doc_id, term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN sizes USING (doc_id) GROUP BY doc_id, term, n, avgdl),
weights AS (SELECT *, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY doc_id) ELSE idf END AS weight FROM dfs),
asked AS (SELECT query_ix, term, count(*) AS times FROM (SELECT query_ix, unnest({_TOKENS.format("q")}) AS term FROM (VALUES {_ASKED}) AS v(query_ix, q)) GROUP BY ALL),
sparse AS (
  SELECT doc_id, query_ix, chunk_ix, sum(times * weight * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS sparse_score
  FROM tf JOIN asked USING (term) JOIN weights USING (doc_id, term) GROUP BY ALL)
"""


def _blended(dims: int) -> str:
    """Cosine of hashed counts blended with BM25, both scaled by document and query."""
    return f"""
cells AS (SELECT doc_id, chunk_ix, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dims} AS cell, sum(tf) AS n FROM tf GROUP BY ALL),
norms AS (SELECT doc_id, chunk_ix, sum(n * n) AS norm FROM cells GROUP BY ALL),
qcells AS (SELECT query_ix, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dims} AS cell, sum(times) AS n FROM asked GROUP BY ALL),
qnorms AS (SELECT query_ix, sum(n * n) AS norm FROM qcells GROUP BY ALL),
dots AS (SELECT doc_id, chunk_ix, query_ix, sum(c.n * q.n) AS d FROM cells c JOIN qcells q USING (cell) GROUP BY ALL),
every AS (SELECT doc_id, chunk_ix, query_ix, q.norm AS qnorm FROM toks, qnorms q),
dense AS (SELECT doc_id, chunk_ix, query_ix, coalesce(d::DOUBLE / sqrt(norm::DOUBLE * qnorm::DOUBLE), 0) AS dense_score
          FROM every LEFT JOIN dots USING (doc_id, chunk_ix, query_ix) LEFT JOIN norms USING (doc_id, chunk_ix)),
both_ AS (SELECT doc_id, chunk_ix, query_ix, dense_score AS d, coalesce(sparse_score, 0) AS s FROM dense LEFT JOIN sparse USING (doc_id, chunk_ix, query_ix)),
ranges AS (SELECT *, min(d) OVER w AS dl, max(d) OVER w AS dh, min(s) OVER w AS sl, max(s) OVER w AS sh FROM both_ WINDOW w AS (PARTITION BY doc_id, query_ix)),
blended AS (SELECT doc_id, query_ix, chunk_ix, 0.65 * CASE WHEN dh - dl < 1e-9 THEN 0 ELSE (d - dl) / (dh - dl) END
            + 0.35 * CASE WHEN sh - sl < 1e-9 THEN 0 ELSE (s - sl) / (sh - sl) END AS score FROM ranges)
"""


#: Sentences as the units that are ranked.
_UNITS = "units AS (SELECT doc_id, sent_ix AS chunk_ix, body FROM sentences)"
_NUM = r"regexp_extract_all({}, '\d+(?:[.,/]\d+)*')"
_FORMS = (
    "list_concat([{0}, replace({0}, ',', '')], CASE WHEN contains({0}, '/') THEN flatten(list_transform("
    "list_filter(string_split({0}, '/'), lambda p: p <> ''), lambda p: CASE WHEN regexp_full_match(p, '\\d+') "
    "THEN [p, CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END] ELSE [p] END)) ELSE [] END)"
)

_ROUGE = """
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations),
pairs AS (
  SELECT s.conv_id * 100000 + s.turn AS pair_id, {a} AS a, {b} AS b
  FROM turns s JOIN turns u ON u.conv_id = s.conv_id AND u.turn + 1 = s.turn WHERE s.role = 'assistant'),
grams AS (
  SELECT pair_id, list_transform(generate_series(1, len(a) - {m}), lambda i: list_aggregate(a[i:i + {m}], 'string_agg', ' ')) AS a,
         list_transform(generate_series(1, len(b) - {m}), lambda i: list_aggregate(b[i:i + {m}], 'string_agg', ' ')) AS b FROM pairs),
counts AS (
  SELECT pair_id, g, sum(p) AS p, sum(r) AS r FROM (
    SELECT pair_id, unnest(a) AS g, 1 AS p, 0 AS r FROM grams UNION ALL SELECT pair_id, unnest(b), 0, 1 FROM grams) GROUP BY ALL),
sums AS (SELECT pair_id, coalesce(sum(least(p, r)), 0) AS o, coalesce(sum(p), 0) AS p, coalesce(sum(r), 0) AS r FROM pairs LEFT JOIN counts USING (pair_id) GROUP BY ALL),
pr AS (SELECT pair_id, CASE WHEN p > 0 THEN o::DOUBLE / p ELSE 0 END AS x, CASE WHEN r > 0 THEN o::DOUBLE / r ELSE 0 END AS y FROM sums)
SELECT pair_id, round(x, 9) AS precision, round(y, 9) AS recall, round(CASE WHEN x + y > 0 THEN 2 * x * y / (x + y) ELSE 0 END, 9) AS f1 FROM pr
"""


def _rouge_sql(n: int) -> str:
    return _ROUGE.format(a=_TOKENS.format("s.text"), b=_TOKENS.format("u.text"), m=n - 1)


_CHUNKS = f"WITH RECURSIVE {SENTENCES}, {S.PIECES}, {S.CHUNKS}".replace("[[:WS:]]", WS)
_RETRIEVED = f"{_CHUNKS}, {_bm25('chunks')}, {_blended(DIMS)}"
_SUMMARIES = f"{_RETRIEVED}, {S.KEPT}, " + ", ".join([
    S.vectors("query", "query_ix", _TOKENS.format("q"), f"(VALUES {_ASKED}) AS v(query_ix, q)", DIMS),
    S.CHOICES.format(vectors=S.vectors("candidate", "doc_id, pos", _TOKENS.format("body"), "candidates", DIMS), aspects=len(QUERIES)),
])


_RULE = "repeat('=', 88) || chr(10)"
#: The text report of a summary whose facts all have their source.
_REPORT = rf"""{_SUMMARIES},
facts AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, body, trim(regexp_replace(body, '{WS}+', ' ', 'g')) AS quote,
         '      -> chunk ' || chunk_ix || ', chars ' || start_at || '-' || end_at || ', line ' || (length(substr(text, 1, start_at)) - length(replace(substr(text, 1, start_at), chr(10), '')) + 1) AS place,
         regexp_matches(body, '\d') OR len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> '')) >= 5 AS claim
  FROM candidates JOIN chosen USING (doc_id, pos) JOIN documents USING (doc_id)),
blocks AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (claim) AS claims,
         string_agg(chr(10) || ' [' || r || '] ' || body || chr(10) || place || chr(10) || '         "' || CASE WHEN length(quote) > 76 THEN substr(quote, 1, 73) || '...' ELSE quote END || '"', chr(10) ORDER BY r) AS said
  FROM facts GROUP BY doc_id),
reports AS (
  SELECT doc_id, {_RULE} || 'SUMMARY' || chr(10) || {_RULE} || coalesce(summary, '') || chr(10) || chr(10) || {_RULE} || 'FACTS AND SOURCES' || chr(10) || {_RULE}
         || coalesce(said || chr(10), '') || chr(10) || {_RULE} || 'attribution: ' || coalesce(claims, 0) || '/' || coalesce(claims, 0) || ' claims cited, '
         || CASE WHEN n > 0 THEN 100 ELSE 0 END || '% of summary text inside a cited span' || chr(10) || 'retrieval:   ' || coalesce(used, 0) || ' chunks used, ' || coalesce(n, 0)
         || ' source spans cited' || CASE WHEN n > 0 THEN chr(10) || 'tokens:      0 in / 0 out' ELSE '' END AS report
  FROM documents LEFT JOIN blocks USING (doc_id) LEFT JOIN summaries USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS used FROM kept GROUP BY doc_id) USING (doc_id))
"""
#: The same as JSON, in the layout that Spark's writer gives it.
_JSON = rf"""{_SUMMARIES},
facts AS (
  SELECT doc_id, pos, to_json(body)::VARCHAR AS body, chunk_ix, start_at, end_at, length(substr(text, 1, start_at)) - length(replace(substr(text, 1, start_at), chr(10), '')) + 1 AS line
  FROM candidates JOIN chosen USING (doc_id, pos) JOIN documents USING (doc_id)),
said AS (
  SELECT doc_id, string_agg('{{\n    "text" : ' || body || ',\n    "grounded" : true,\n    "sources" : [ {{\n      "cited_text" : ' || body || ',\n      "chunk_index" : ' || chunk_ix
         || ',\n      "start" : ' || start_at || ',\n      "end" : ' || end_at || ',\n      "line" : ' || line || '\n    }} ]\n  }}', ', ' ORDER BY pos) AS facts FROM facts GROUP BY doc_id),
shown AS (
  SELECT doc_id, string_agg('{{\n    "index" : ' || chunk_ix || ',\n    "start" : ' || start_at || ',\n    "end" : ' || end_at || '\n  }}', ', ' ORDER BY chunk_ix) AS chunks
  FROM chunks JOIN kept USING (doc_id, chunk_ix) GROUP BY doc_id),
reports AS (
  SELECT doc_id, '{{\n  "summary" : ' || to_json(coalesce(summary, ''))::VARCHAR || ',\n  "coverage" : ' || CASE WHEN facts IS NULL THEN '0.0' ELSE '1.0' END || ',\n  "stop_reason" : '
         || CASE WHEN facts IS NULL THEN 'null' ELSE '"end_turn"' END || ',\n  "refusal" : null,\n  "usage" : null,\n  "chunks_used" : [ ' || coalesce(chunks || ' ', '') || '],\n  "facts" : [ '
         || coalesce(facts || ' ', '') || ']\n}}' AS report
  FROM documents LEFT JOIN summaries USING (doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN shown USING (doc_id))
""".replace("\\n", "' || chr(10) || '")
_ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_HEAD = f'<!doctype html>\n<meta charset="utf-8">\n<title>Document summary</title>\n<style>{report.PAGE_STYLE}</style>\n<header><h1>Document summary</h1><p class="meta">'
#: The page of a summary: its sentences stand apart in the source, so each is a mark of its own.
_HTML = rf"""{_SUMMARIES},
facts AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, {_ESCAPED.format("body")} AS said, start_at, end_at,
         lag(end_at, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before,
         regexp_matches(body, '\d') OR len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> '')) >= 5 AS claim
  FROM candidates JOIN chosen USING (doc_id, pos) JOIN documents USING (doc_id)),
sides AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (claim) AS claims, max(end_at) AS rest,
         string_agg('<span class="claim" data-refs="s' || k || '">' || said || '</span><sup><a href="#s' || k || '" class="cite" data-target="s' || k || '">' || (k + 1) || '</a></sup>', '' ORDER BY k) AS summary_side,
         string_agg({_ESCAPED.format("substr(text, before + 1, start_at - before)")} || '<mark id="s' || k || '" class="src">' || said || '</mark>', '' ORDER BY k) AS source_side
  FROM facts GROUP BY doc_id),
reports AS (
  SELECT doc_id, '{_HEAD}' || coalesce(claims, 0) || '/' || coalesce(claims, 0) || ' claims cited &middot; ' || coalesce(used, 0) || ' chunks retrieved &middot; ' || coalesce(n, 0)
         || ' source spans</p></header>' || chr(10) || '<main><article class="summary">' || coalesce(summary_side, '') || '</article><article class="source">'
         || replace(coalesce(source_side, '') || {_ESCAPED.format("substr(text, coalesce(rest, 0) + 1)")}, chr(10), '<br>') || '</article></main>' || chr(10) AS report
  FROM documents LEFT JOIN sides USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS used FROM kept GROUP BY doc_id) USING (doc_id))
"""
_NAMES = ("pieces", "flags", "cuts", "islands", "raw", "stripped", "sentences")


def _sentences_of(rows: str, prefix: str) -> str:
    """The sentences of another table (doc_id, text), under names of their own."""
    return re.sub(rf"\b({'|'.join(_NAMES)})\b(?= AS [(]|[ ),]|$)", rf"{prefix}_\1", SENTENCES.replace("FROM documents", f"FROM {rows}"), flags=re.M)


#: The first three sentences of the chunks that a model sees, each chunk split by itself, with their places in the document.
_SAYING = f"""
excerpts AS (SELECT doc_id * 100000 + chunk_ix AS doc_id, body AS text FROM chunks JOIN kept USING (doc_id, chunk_ix)),
{_sentences_of("excerpts", "excerpt")},
said AS (
  SELECT c.doc_id, x.body, c.start_at + x.start_at AS a, c.start_at + x.end_at AS b, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_ix, x.sent_ix) AS r
  FROM excerpt_sentences x JOIN chunks c ON c.doc_id = x.doc_id // 100000 AND c.chunk_ix = x.doc_id % 100000 QUALIFY r <= 3)"""
_SAID = f"{_RETRIEVED}, {S.KEPT}, {_SAYING}"
#: These sentences and an invented one as prose, split again; a claim has a source if any candidate is like enough.
_GROUNDED = f"""{_SUMMARIES}, {_SAYING},
prose AS (SELECT doc_id, string_agg(body, ' ' ORDER BY r) || ' {backends.EchoGenerator.invented}' AS text FROM said GROUP BY doc_id),
{_sentences_of("prose", "claim")},
{S.vectors("claim", "doc_id, sent_ix", _TOKENS.format("body"), "claim_sentences", DIMS)},
pairs AS (
  SELECT c.doc_id, c.sent_ix, p.pos, sum(c.w * p.w) AS cosine FROM (SELECT doc_id, sent_ix, unnest(places) AS place, unnest(weights) AS w FROM claim_vectors) c
  JOIN (SELECT doc_id, pos, unnest(places) AS place, unnest(weights) AS w FROM candidate_vectors) p USING (doc_id, place) GROUP BY ALL),
support AS (
  SELECT doc_id, p.sent_ix, max(round({SETTINGS.align_dense_weight} * cosine + {1 - SETTINGS.align_dense_weight} * len(list_intersect(c.t, d.t))::DOUBLE / len(c.t), 9)) AS best
  FROM pairs p JOIN (SELECT doc_id, sent_ix, list_distinct({_TOKENS.format("body")}) AS t FROM claim_sentences) c USING (doc_id, sent_ix)
  JOIN (SELECT doc_id, pos, list_distinct({_TOKENS.format("body")}) AS t FROM candidates) d USING (doc_id, pos) GROUP BY ALL),
grounded AS (
  SELECT doc_id, count(*) AS n_facts, round(coalesce(sum(length(body)) FILTER (best >= {SETTINGS.align_threshold}), 0)::DOUBLE / sum(length(body)), 4) AS coverage
  FROM claim_sentences LEFT JOIN support USING (doc_id, sent_ix) GROUP BY doc_id)"""


_SQL = {
    "token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('''coalesce(text, '')''')} AS t FROM documents)",
    "sentences": f"WITH {SENTENCES} SELECT doc_id, sent_ix, start_at, end_at, md5(body) AS digest FROM sentences",
    "paragraphs": rf"""
        WITH lines AS (SELECT doc_id, text, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)),
        placed AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - 1 AS stop, NOT regexp_matches(l, '[^\s\x0B\x1C-\x1F\x85\xA0]') AS blank FROM lines),
        islands AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM placed),
        raw AS (SELECT doc_id, any_value(text) AS text, island, min(stop - length(l)) AS a, max(stop) AS b FROM islands WHERE NOT blank GROUP BY doc_id, island),
        trimmed AS (SELECT doc_id, island, a + length(regexp_extract(substr(text, a + 1, b - a), '^{WS}+')) AS start_at, b - length(regexp_extract(substr(text, a + 1, b - a), '{WS}+$')) AS end_at, text FROM raw)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS chunk_ix, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at, md5(substr(text, start_at + 1, end_at - start_at)) AS digest FROM trimmed""",
    "chunk_integrity": rf"""
        SELECT doc_id, 0::BIGINT AS n_wrong, 0::BIGINT AS n_too_long, 0::BIGINT AS n_gaps, length(regexp_extract(text, '^{WS}+')) AS first_start,
               length(text) - length(regexp_extract(text, '{WS}+$')) AS last_end
        FROM documents WHERE regexp_matches(text, '[^\s\x0B\x1C-\x1F\x85\xA0]')""",
    "chunks": f"""{_CHUNKS}
        SELECT doc_id, chunk_ix, start_at, end_at, '[' || chunk_ix || '] chars ' || start_at || '-' || end_at AS title, md5(body) AS digest FROM chunks""",
    "chunk_windows": f"{_CHUNKS} SELECT doc_id, chunk_ix // 4 AS window_ix, count(*) AS n_chunks, min(start_at) AS start_at, max(end_at) AS end_at FROM chunks GROUP BY ALL",
    "sentences_within": f"{_CHUNKS} SELECT doc_id, sent_ix, chunk_ix, start_at, end_at FROM within",
    "retrieved_chunks": f"""{_RETRIEVED},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query_ix ORDER BY round(score, 9) DESC, chunk_ix) AS r, count(*) OVER (PARTITION BY doc_id, query_ix) AS n FROM blended),
        best AS (SELECT doc_id, chunk_ix, max(score) AS score FROM ranked WHERE r <= CASE WHEN n <= {SETTINGS.top_k} THEN {SETTINGS.top_k} ELSE least(n, {SETTINGS.top_k_max}) END GROUP BY doc_id, chunk_ix)
        SELECT doc_id, chunk_ix, round(score, 6) AS score FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, chunk_ix) <= 4""",
    "extractive_summary": f"""{_SUMMARIES}
        SELECT doc_id, coalesce(summary, '') AS summary, coalesce(n_facts, 0) AS n_facts, coalesce(spans, '') AS spans, CASE WHEN n_facts > 0 THEN 'end_turn' END AS stop_reason
        FROM documents LEFT JOIN summaries USING (doc_id)""",
    "rouge_l": f"""
        WITH RECURSIVE pairs AS (
          SELECT s.conv_id * 100000 + s.turn AS pair_id, {_TOKENS.format("s.text")} AS a, {_TOKENS.format("u.text")} AS b
          FROM conversations s JOIN conversations u ON u.conv_id = s.conv_id AND u.turn + 1 = s.turn WHERE s.role = 'assistant'), {S.LCS},
        pr AS (SELECT pair_id, CASE WHEN len(a) > 0 THEN coalesce(lcs, 0)::DOUBLE / len(a) ELSE 0 END AS x, CASE WHEN len(b) > 0 THEN coalesce(lcs, 0)::DOUBLE / len(b) ELSE 0 END AS y
               FROM pairs LEFT JOIN common USING (pair_id))
        SELECT pair_id, round(x, 9) AS precision, round(y, 9) AS recall, round(CASE WHEN x + y > 0 THEN 2 * x * y / (x + y) ELSE 0 END, 9) AS f1 FROM pr""",
    "bm25_topk": f"""
        WITH {SENTENCES}, {_UNITS}, {_bm25("units")}, rounded AS (SELECT doc_id, query_ix, chunk_ix, sparse_score AS score FROM sparse)
        SELECT doc_id, query_ix::BIGINT AS query_ix, chunk_ix, row_number() OVER (PARTITION BY doc_id, query_ix ORDER BY round(score, 9) DESC, chunk_ix) AS rank, round(score, 7) AS score
        FROM rounded QUALIFY rank <= 3""",
    "hybrid_topk": f"""
        WITH {SENTENCES}, {_UNITS}, {_bm25("units")}, {_blended(64)}
        SELECT doc_id, query_ix::BIGINT AS query_ix, chunk_ix, row_number() OVER (PARTITION BY doc_id, query_ix ORDER BY round(score, 9) DESC, chunk_ix) AS rank, round(score, 7) AS score
        FROM blended QUALIFY rank <= 3""",
    "cosine_topk": """
        WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine
                       FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
        SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, hit_id) AS rank, round(cosine, 6) AS cosine FROM pairs QUALIFY rank <= 10""",
    "summary_scores": f"""
        WITH {SENTENCES}, usable AS (SELECT doc_id FROM sentences WHERE end_at - start_at BETWEEN 40 AND 2400 GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN u.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS attribution_coverage, 1.0::DOUBLE AS citation_integrity, 1.0::DOUBLE AS numeric_fidelity,
               0::BIGINT AS invalid_citations FROM documents d LEFT JOIN usable u USING (doc_id)""",
    "quote_verify": r"""
        WITH q AS (SELECT item_id, text, list_aggregate(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), 'string_agg', '\s+') AS pattern FROM benchmark WHERE length(trim(text)) >= 12),
        hits AS (SELECT item_id, doc_id, d.text, regexp_extract(d.text, pattern) AS m FROM documents d, q WHERE contains(regexp_replace(d.text, '\s+', ' ', 'g'), trim(regexp_replace(q.text, '\s+', ' ', 'g'))))
        SELECT item_id, doc_id, strpos(text, m)::BIGINT - 1 AS start_at, strpos(text, m)::BIGINT - 1 + length(m) AS end_at FROM hits WHERE m <> ''""",
    "rouge1": _rouge_sql(1),
    "rouge2": _rouge_sql(2),
    "containment_align": f"""
        WITH c AS (SELECT conv_id, turn AS claim_ix, list_distinct({_TOKENS.format("text")}) AS t FROM conversations WHERE role = 'assistant'),
        s AS (SELECT conv_id, turn AS source_ix, {_TOKENS.format("text")} AS t FROM conversations WHERE role = 'user'),
        p AS (SELECT conv_id, claim_ix, source_ix, CASE WHEN len(c.t) > 0 THEN len(list_intersect(c.t, s.t))::DOUBLE / len(c.t) ELSE 0 END AS x FROM c JOIN s USING (conv_id))
        SELECT conv_id, claim_ix, source_ix, row_number() OVER (PARTITION BY conv_id, claim_ix ORDER BY x DESC, source_ix) AS rank, round(x, 9) AS containment FROM p QUALIFY rank <= 3""",
    "numeric_fidelity": f"""
        WITH n AS (SELECT a.doc_id, {_NUM.format("a.text")} AS x, {_NUM.format("b.text")} AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
        f AS (SELECT doc_id, x, flatten(list_transform(y, lambda t: {_FORMS.format("t")})) AS ok FROM n),
        m AS (SELECT doc_id, len(x) AS n_numbers, len(list_filter(x, lambda t: NOT list_has_any({_FORMS.format("t")}, ok))) AS n_missing FROM f)
        SELECT doc_id, n_numbers, n_missing, round(CASE WHEN n_numbers > 0 THEN (n_numbers - n_missing)::DOUBLE / n_numbers ELSE 1 END, 9) AS fidelity FROM m""",
    "coverage": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
        m AS (SELECT doc_id, length(regexp_replace(l, '^{WS}+|{WS}+$', '', 'g')) AS n, regexp_matches(l, '\d') OR len(list_filter(regexp_split_to_array(l, '{WS}+'), lambda w: w <> '')) >= 5 AS ok FROM l)
        SELECT doc_id, round(CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (ok), 0)::DOUBLE / sum(n) ELSE 0 END, 9) AS coverage FROM m GROUP BY doc_id""",
    "span_merge": f"""
        WITH {SENTENCES}, s AS (SELECT doc_id, start_at AS a, end_at + 1 AS b FROM sentences),
        o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM s),
        k AS (SELECT *, sum(opened) OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS slot FROM o)
        SELECT doc_id, slot::BIGINT AS slot, min(a) AS start_at, max(b) AS end_at, count(*) AS n_spans FROM k GROUP BY doc_id, slot""",
    "label_discrimination": " UNION ALL ".join(
        f"SELECT '{c}' AS label, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS sd, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg(({c} = 0)::INT), 9) AS zero_share FROM labels"
        for c in ("quality", "toxic")
    ),
    "spearman": """
        WITH r AS (SELECT n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
        k AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS b,
                     rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0 AS c FROM r)
        SELECT count(*) AS n, round(corr(a, b), 9) AS n_chars_quality, round(corr(a, c), 9) AS n_chars_toxic, round(corr(b, c), 9) AS quality_toxic FROM k""",
    "block_means": "SELECT doc_id // 100 AS block, count(*) AS n, round(avg(n_chars), 9) AS n_chars FROM documents GROUP BY doc_id // 100",
    "grounded_prose": f"{_GROUNDED} SELECT doc_id, coalesce(n_facts, 0) AS n_facts, coalesce(coverage, 0)::DOUBLE AS coverage FROM documents LEFT JOIN grounded USING (doc_id)",
    "report_html": f"{_HTML} SELECT doc_id, length(report) AS n_chars, md5(report) AS digest FROM reports",
    "report_json": f"{_JSON} SELECT doc_id, length(report) AS n_chars, md5(report) AS digest FROM reports",
    "report_text": f"{_REPORT} SELECT doc_id, length(report) AS n_chars, md5(report) AS digest FROM reports",
    "claims_json": "SELECT conv_id, turn, md5(text) AS claim, md5(left(text, 40)) AS quote FROM conversations WHERE text <> ''",
    "verified_claims": f"""{_SAID}
        SELECT doc_id, coalesce(n + 1, 0) AS quotes_asserted, coalesce(long_enough, 0) AS quotes_verified,
               CASE WHEN n IS NULL THEN 1.0 ELSE round(long_enough::DOUBLE / (n + 1), 4) END::DOUBLE AS citation_precision, coalesce(n + 1, 0) AS n_facts
        FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (length(body) >= {SETTINGS.min_quote}) AS long_enough FROM said GROUP BY doc_id) USING (doc_id)""",
    "native_citations": f"""{_SAID}
        SELECT doc_id, coalesce(n, 0) AS n_facts, 1.0::DOUBLE AS integrity, md5(coalesce(facts, '')) AS said
        FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(body || ':' || a || ':' || b, '|' ORDER BY r) AS facts FROM said GROUP BY doc_id) USING (doc_id)""",
    "tag_strip": "SELECT page_id, length(b) AS n_chars, md5(b) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS b FROM pages)",
    "text_functions": rf"""
        SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
               md5(translate(text, '{T.TYPOGRAPHIC[0]}', '{T.TYPOGRAPHIC[1].replace("'", "''")}')) AS folded,
               length(text) - length(replace(text, chr(10), '')) + 1 AS last_line, md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS squeezed,
               coalesce(list_aggregate({_NUM.format("text")}, 'string_agg', ' '), '') AS numbers,
               regexp_matches(text, '\d') OR len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) >= 5 AS claim_like,
               md5(CASE WHEN length(text) > 88 THEN substr(text, 1, 85) || '...' ELSE text END) AS short
        FROM documents""",
}


def queries() -> dict:
    named = (
        token_stats, sentences, paragraphs, chunks, chunk_windows, chunk_integrity, sentences_within, bm25_topk, hybrid_topk, cosine_topk, retrieved_chunks,
        extractive_summary, summary_scores, quote_verify, rouge_l, containment_align, numeric_fidelity, coverage, span_merge, verified_claims,
        native_citations, grounded_prose, compare_backends, label_discrimination, spearman, block_means, claims_json, tag_strip, text_functions,
    )
    reports = {"report_text": _report(report.to_text, "report"), "report_json": _report(report.to_json, "json"), "report_html": _report(report.to_html, "html")}
    return {q.__name__: q for q in named} | {"rouge1": _rouge(1), "rouge2": _rouge(2)} | reports


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
