"""DuckDB SQL for chunks, retrieval over chunks, and the extractive summary: an independent statement of their results.

Every name here is a common table expression that builds on the ``sentences`` of :mod:`queries`. Loops
are recursive: over a document's chunks, over the choices of a summary, over the tokens of a text.
"""

from __future__ import annotations

from ..config import SETTINGS as S

#: Sentences over the ceiling in pieces: each cut at the last blank of its second half, if there is one.
PIECES = rf"""
long_sentences AS (SELECT s.doc_id, sent_ix, start_at AS a, end_at AS b, text FROM sentences s JOIN documents USING (doc_id) WHERE end_at - start_at > {S.chunk_ceiling}),
cutting(doc_id, sent_ix, k, a, stop, b, text) AS (
  SELECT doc_id, sent_ix, 0, NULL::BIGINT, a, b, text FROM long_sentences
  UNION ALL
  SELECT doc_id, sent_ix, k + 1, stop,
         CASE WHEN stop + {S.chunk_ceiling} >= b THEN b
              WHEN contains(substr(text, stop + {S.chunk_ceiling // 2} + 1, {S.chunk_ceiling - S.chunk_ceiling // 2}), ' ')
              THEN stop + {S.chunk_ceiling // 2} + length(regexp_extract(substr(text, stop + {S.chunk_ceiling // 2} + 1, {S.chunk_ceiling - S.chunk_ceiling // 2}), '(?s)^.* ')) - 1
              ELSE stop + {S.chunk_ceiling} END, b, text
  FROM cutting WHERE stop < b),
cut_pieces AS (
  SELECT doc_id, sent_ix, k, a + length(regexp_extract(substr(text, a + 1, stop - a), '^[[:WS:]]+')) AS a, stop - length(regexp_extract(substr(text, a + 1, stop - a), '[[:WS:]]+$')) AS b
  FROM cutting WHERE k > 0),
piece_rows AS (
  SELECT doc_id, sent_ix, k, a, b FROM cut_pieces WHERE b > a
  UNION ALL SELECT doc_id, sent_ix, 0, start_at, end_at FROM sentences WHERE end_at - start_at <= {S.chunk_ceiling}),
piece_lists AS (SELECT doc_id, list(a ORDER BY sent_ix, k) AS s, list(b ORDER BY sent_ix, k) AS e, count(*) AS n FROM piece_rows GROUP BY doc_id)
"""

#: Chunks: one step of the recursion is one chunk; ``first`` is its first piece, ``new`` the first piece that no chunk has yet.
CHUNKS = rf"""
walk(doc_id, k, first, new, a, b) AS (
  SELECT doc_id, -1::BIGINT, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM piece_lists
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN filled > n THEN n + 1 WHEN passed <= filled AND e[stop] - s[greatest(first, stop - {S.chunk_overlap})] > {S.chunk_ceiling} THEN stop
                             ELSE greatest(first, stop - {S.chunk_overlap}) END, stop, s[first], e[stop - 1]
  FROM (SELECT *, CASE WHEN filled > n THEN n + 1 ELSE least(filled + 1, passed) END AS stop
        FROM (SELECT w.doc_id, w.k, w.first, w.new, l.s, l.e, l.n,
                     coalesce(list_min(list_filter(range(w.new, l.n + 1), lambda i: l.e[i] - l.s[w.first] >= {S.chunk_chars})), l.n + 1) AS filled,
                     coalesce(list_min(list_filter(range(w.new, l.n + 1), lambda i: l.e[i] - l.s[w.first] > {S.chunk_ceiling})), l.n + 1) AS passed
              FROM walk w JOIN piece_lists l USING (doc_id) WHERE w.new <= l.n))),
chunks AS (SELECT w.doc_id, k AS chunk_ix, a AS start_at, b AS end_at, substr(text, a + 1, b - a) AS body FROM walk w JOIN documents USING (doc_id) WHERE k >= 0),
within AS (
  SELECT s.doc_id, s.sent_ix, s.start_at, s.end_at, s.body, min(c.chunk_ix) AS chunk_ix
  FROM sentences s JOIN chunks c ON c.doc_id = s.doc_id AND c.start_at <= s.start_at AND s.end_at <= c.end_at
  WHERE s.end_at - s.start_at >= {S.min_sentence} GROUP BY ALL)
"""

#: Counts of hashed tokens as unit vectors, of texts and of queries.
_VECTOR = """
{name}_places AS (SELECT {keys}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dims} AS place, count(*) AS n FROM (SELECT {keys}, unnest({tokens}) AS term FROM {rows}) GROUP BY ALL),
{name}_vectors AS (SELECT {keys}, list(place ORDER BY place) AS places, list(n / norm ORDER BY place) AS weights
                   FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY {keys}))::DOUBLE AS norm FROM {name}_places) GROUP BY {keys})
"""


def vectors(name: str, keys: str, tokens: str, rows: str, dims: int) -> str:
    return _VECTOR.format(name=name, keys=keys, tokens=tokens, rows=rows, dims=dims)


#: Chunks that retrieval keeps without a budget: all of a document with few, else what any query ranks among the best.
KEPT = f"""
kept AS (
  SELECT doc_id, chunk_ix FROM chunks WHERE doc_id IN (SELECT doc_id FROM chunks GROUP BY doc_id HAVING count(*) <= {S.top_k_max})
  UNION SELECT doc_id, chunk_ix FROM (
    SELECT doc_id, query_ix, chunk_ix, row_number() OVER (PARTITION BY doc_id, query_ix ORDER BY round(score, 9) DESC, chunk_ix) AS r FROM blended) WHERE r <= {S.top_k_max})
"""

#: A summary's choices. One step takes one sentence: for the aspect of the step while there are aspects, then by marginal relevance.
CHOICES = f"""
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_ix) AS pos
  FROM (SELECT s.doc_id, sent_ix, start_at, end_at, s.body, min(c.chunk_ix) AS chunk_ix
        FROM sentences s JOIN (SELECT doc_id, chunk_ix, start_at AS lo, end_at AS hi FROM chunks JOIN kept USING (doc_id, chunk_ix)) c ON c.doc_id = s.doc_id
        WHERE lo <= start_at AND end_at <= hi AND end_at - start_at >= {S.min_sentence} GROUP BY ALL)),
{{vectors}},
likeness AS (
  SELECT doc_id, p.pos, q.pos AS other, sum(p.w * q.w) AS cosine
  FROM (SELECT doc_id, pos, unnest(places) AS place, unnest(weights) AS w FROM candidate_vectors) p
  JOIN (SELECT doc_id, pos, unnest(places) AS place, unnest(weights) AS w FROM candidate_vectors) q USING (doc_id, place) GROUP BY ALL),
likeness_lists AS (
  SELECT c.doc_id, list(coalesce(cosine, 0) ORDER BY c.pos, o.pos) AS cosines FROM candidates c JOIN candidates o ON o.doc_id = c.doc_id
  LEFT JOIN likeness l ON l.doc_id = c.doc_id AND l.pos = c.pos AND l.other = o.pos GROUP BY c.doc_id),
relevance AS (
  SELECT c.doc_id, query_ix, list(coalesce(x, 0) ORDER BY c.pos) AS scores
  FROM candidates c CROSS JOIN (SELECT DISTINCT query_ix FROM asked) a
  LEFT JOIN (SELECT doc_id, pos, query_ix, sum(p.w * q.w) AS x
             FROM (SELECT doc_id, pos, unnest(places) AS place, unnest(weights) AS w FROM candidate_vectors) p
             JOIN (SELECT query_ix, unnest(places) AS place, unnest(weights) AS w FROM query_vectors) q USING (place) GROUP BY ALL) r USING (doc_id, pos, query_ix)
  GROUP BY c.doc_id, query_ix),
pools AS (
  SELECT c.doc_id, n, greatest({S.summary_least}, least({S.summary_most}, round_even(n * {S.summary_ratio}, 0)::BIGINT, n)) AS budget, aspects, cosines,
         list_transform(range(1, n + 1), lambda i: list_max(list_transform(aspects, lambda s: s[i]))) AS pooled
  FROM (SELECT doc_id, count(*) AS n FROM candidates GROUP BY doc_id) c
  JOIN (SELECT doc_id, list(scores ORDER BY query_ix) AS aspects FROM relevance GROUP BY doc_id) USING (doc_id) JOIN likeness_lists USING (doc_id)),
choosing(doc_id, step, taken, value) AS (
  SELECT doc_id, 0, []::BIGINT[], []::DOUBLE[] FROM pools
  UNION ALL
  SELECT doc_id, step + 1,
         CASE WHEN best IS NOT NULL AND (step >= {{aspects}} OR list_max(value) >= {S.aspect_floor}) THEN list_append(taken, best) ELSE taken END, value
  FROM (SELECT *, list_position(value, list_max(value)) AS best
        FROM (SELECT c.doc_id, c.step, c.taken,
                     list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(c.taken, i) THEN NULL
                       WHEN c.step < {{aspects}} THEN round(aspects[c.step + 1][i], 9)
                       ELSE round({S.mmr_lambda} * pooled[i] - (1 - {S.mmr_lambda}) * coalesce(list_max(list_transform(c.taken, lambda j: cosines[(i - 1) * n + j])), 0), 9) END) AS value
              FROM choosing c JOIN pools p USING (doc_id) WHERE len(c.taken) < least(budget, n)))),
chosen AS (SELECT doc_id, unnest(arg_max(taken, step)) AS pos FROM choosing GROUP BY doc_id),
summaries AS (
  SELECT doc_id, string_agg(body, ' ' ORDER BY pos) AS summary, count(*) AS n_facts,
         string_agg(chunk_ix || ':' || start_at || ':' || end_at, ',' ORDER BY pos) AS spans FROM candidates JOIN chosen USING (doc_id, pos) GROUP BY doc_id)
"""

#: Longest common subsequences: one step is one token of ``a``; a row's running maximum takes in the matches.
LCS = """
sides AS (SELECT pair_id, a, unnest(b) AS token, generate_subscripts(b, 1) AS j FROM pairs WHERE len(a) > 0),
rows_(pair_id, i, j, v) AS (
  SELECT pair_id, 0, j, 0::BIGINT FROM sides
  UNION ALL
  SELECT pair_id, i + 1, j, max(hit) OVER (PARTITION BY pair_id ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (SELECT r.pair_id, r.i, r.j, CASE WHEN s.a[r.i + 1] = s.token THEN lag(r.v, 1, 0) OVER (PARTITION BY r.pair_id ORDER BY r.j) + 1 ELSE r.v END AS hit
        FROM rows_ r JOIN sides s ON s.pair_id = r.pair_id AND s.j = r.j WHERE r.i < len(s.a))),
common AS (SELECT pair_id, max(v) AS lcs FROM rows_ GROUP BY pair_id)
"""
