"""Pieces of DuckDB SQL that the checks of several queries share."""

from __future__ import annotations

from corvane.functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "(" + ", ".join(quoted(w) for w in T.STOPWORDS) + ")"


def stem(w: str) -> str:
    cases = []
    for s in T.SUFFIXES:
        cut = f"left({w}, length({w}) - {len(s)})" + (" || 'y'" if s == "ies" else "")
        cases.append(f"WHEN suffix({w}, '{s}') AND length({w}) > {len(s) + 2} THEN {cut}")
    return f"CASE {' '.join(cases)} ELSE {w} END"


def tokens(s: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(coalesce({s}, ''), {quoted(T.LINK)}, ' ', 'gi')), {quoted(T.TOKEN)})"


def terms(select: str) -> str:
    """(k, term) of ``select``, which gives k and a text s."""
    return f"""SELECT k, term FROM (SELECT k, {stem('w')} AS term FROM (SELECT k, unnest({tokens('s')}) AS w FROM ({select})) WHERE w NOT IN {STOP}) WHERE term <> '' AND term NOT IN {STOP}"""


DOCS = "SELECT doc_id AS k, text AS s FROM documents"
QUERIES = "SELECT item_id AS k, text AS s FROM benchmark"
FIELD_QUERIES = "SELECT item_id AS k, text || ' en src' || (item_id % 20) AS s FROM benchmark"

#: One field: t, post, lens, st, df, q.
INDEX = f"""
t AS MATERIALIZED ({terms(DOCS)}),
post AS MATERIALIZED (SELECT k AS doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lens AS MATERIALIZED (SELECT d.doc_id, coalesce(x.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, sum(tf)::BIGINT AS dl FROM post GROUP BY 1) x USING (doc_id)),
st AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM lens),
df AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY 1),
q AS MATERIALIZED (SELECT k AS query_id, term, count(*) AS qtf FROM ({terms(QUERIES)}) GROUP BY ALL)"""

#: Three fields: the same with a column field.
FIELD_INDEX = f"""
t AS MATERIALIZED (
  SELECT 'description' AS field, k, term FROM ({terms(DOCS)})
  UNION ALL SELECT 'genres', k, term FROM ({terms("SELECT doc_id AS k, lang AS s FROM documents")})
  UNION ALL SELECT 'characters', k, term FROM ({terms("SELECT doc_id AS k, source AS s FROM documents")})),
post AS MATERIALIZED (SELECT field, k AS doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lens AS MATERIALIZED (SELECT f.field, d.doc_id, coalesce(x.dl, 0) AS dl FROM documents d CROSS JOIN (VALUES ('description'), ('genres'), ('characters')) f(field)
  LEFT JOIN (SELECT field, doc_id, sum(tf)::BIGINT AS dl FROM post GROUP BY ALL) x ON x.field = f.field AND x.doc_id = d.doc_id),
st AS (SELECT field, avg(dl) AS avgdl, count(*) AS n FROM lens GROUP BY 1),
df AS MATERIALIZED (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
q AS MATERIALIZED (SELECT k AS query_id, term, count(*) AS qtf FROM ({terms(FIELD_QUERIES)}) GROUP BY ALL)"""


def top(score_cte: str, k: int = 10) -> str:
    """The k best of (query_id, doc_id, score) in ``score_cte``."""
    return f"""SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id::VARCHAR) AS rank FROM {score_cte}) WHERE rank <= {k}"""


#: Dense, sparse and stub scores on ``embeddings``; queries are the rows whose identifier is divisible by 50.
VECTORS = """
qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS ql, ['text', 'image', 'image_text'][1 + (vec_id // 50) % 3] AS query_type FROM embeddings WHERE vec_id % 50 = 0),
xs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
dall AS MATERIALIZED (SELECT query_id, id, list_dot_product(qs.v, xs.v) AS score FROM qs, xs),
dense AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dall) WHERE rank <= 100),
flat AS (SELECT id, i - 1 AS dim, v[i] AS weight FROM xs, range(1, 65) r(i)),
sp AS MATERIALIZED (SELECT id, dim, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, dim) AS n FROM flat WHERE weight > 0) WHERE n <= 16),
sall AS MATERIALIZED (SELECT a.id AS query_id, b.id, sum(a.weight * b.weight) AS score FROM sp a JOIN sp b USING (dim) WHERE a.id % 50 = 0 GROUP BY ALL),
sparse AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sall WHERE score > 0) WHERE rank <= 100),
ty AS (SELECT query_id, query_type FROM qs),
dn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN CASE WHEN max(score) OVER w <> 0 THEN 1.0 ELSE 0.0 END ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM dense WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN CASE WHEN max(score) OVER w <> 0 THEN 1.0 ELSE 0.0 END ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM sparse WINDOW w AS (PARTITION BY query_id)),
both_ AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, d.score AS dense_score, s.score AS sparse_score, d.rank AS dr, s.rank AS sr, d.norm AS dnorm, s.norm AS snorm FROM dn d FULL JOIN sn s ON d.query_id = s.query_id AND d.id = s.id)"""

RRF = """
rrf0 AS (SELECT b.*, query_type, coalesce(1.0 / (60 + dr), 0.0) + CASE WHEN query_type <> 'image' THEN coalesce(1.0 / (60 + sr), 0.0) ELSE 0.0 END AS prefusion_score FROM both_ b JOIN ty USING (query_id)),
rrf AS MATERIALIZED (SELECT query_id, query_type, id, dense_score, sparse_score, prefusion_score, row_number() OVER (PARTITION BY query_id ORDER BY round(prefusion_score, 12) DESC, round(dense_score, 9) DESC NULLS LAST, id) AS rank FROM rrf0)"""

RERANKED = """
ce AS (SELECT r.query_id, r.query_type, r.id, r.rank, r.prefusion_score, coalesce(dense_score, 0) AS d0, coalesce(sparse_score, 0) AS s0, CASE WHEN r.query_type = 'image' THEN 0.0 ELSE list_dot_product(a.v[1:8], b.v[1:8]) END AS c FROM rrf r JOIN qs a ON a.query_id = r.query_id JOIN xs b ON b.id = r.id WHERE r.rank <= 100),
z AS (SELECT *, CASE WHEN stddev_pop(c) OVER w < 1e-9 THEN 0.0 ELSE (c - avg(c) OVER w) / stddev_pop(c) OVER w END AS zc, CASE WHEN stddev_pop(d0) OVER w < 1e-9 THEN 0.0 ELSE (d0 - avg(d0) OVER w) / stddev_pop(d0) OVER w END AS zd,
  CASE WHEN query_type = 'image' OR stddev_pop(s0) OVER w < 1e-9 THEN 0.0 ELSE (s0 - avg(s0) OVER w) / stddev_pop(s0) OVER w END AS zs FROM ce WINDOW w AS (PARTITION BY query_id)),
fin AS (SELECT *, CASE query_type WHEN 'text' THEN 0.65 * zc + 0.20 * zd + 0.15 * zs WHEN 'image' THEN 0.0 * zc + 1.0 * zd + 0.0 * zs ELSE 0.55 * zc + 0.30 * zd + 0.15 * zs END AS final_score FROM z),
rer AS MATERIALIZED (SELECT query_id, query_type, id, c AS cross_encoder_score, final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, round(prefusion_score, 12) DESC, id) AS rank FROM fin),
sta AS (SELECT query_id, query_type, id, c AS cross_encoder_score, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS rank FROM ce)"""

#: Judgments on ``embeddings``: of the same label, grade 2 if the identifiers' difference is even, else 1.
QRELS = """
qrels AS MATERIALIZED (SELECT query_id, id AS doc_id, CASE WHEN (id - query_id) % 2 = 0 THEN 2 ELSE 1 END AS relevance FROM qs JOIN xs ON xs.label = qs.ql)"""
