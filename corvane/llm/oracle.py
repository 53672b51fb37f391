"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from corvane.llm import mixing as M
from corvane.llm import secret_scan as X
from corvane.llm.common import SPACE, WORD


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EXACT = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)"""

WARC = """
WITH t AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS m FROM t WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n AS payload_bytes, sha1(t.h) AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM t LEFT JOIN g ON t.n >= 1000 AND t.h = g.h"""

#: Seats by ranking every quotient that could win one, where the query ranks those between two divisors.
MIXING = f"""
WITH s AS MATERIALIZED (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('7|' || coalesce(doc_id::VARCHAR, '~')) AS draw FROM documents),
src AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1)),
c AS (SELECT *, (rank - 1) % 3 + 1 AS w, {M.MAX_REPEAT} * source_size AS cap FROM src),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den FROM c),
lv AS (SELECT max(struct_pack(den := den, num := num)) FILTER (cap * den > w * num) AS l, sum(source_size) AS total FROM o),
tg AS (SELECT source, source_size, rank, CASE WHEN cap * den <= w * num THEN cap::DOUBLE ELSE (w * l.num)::DOUBLE / l.den::DOUBLE END AS target, round(total / {M.BLOCK})::BIGINT AS seats, total FROM o, lv),
won AS (SELECT rank, count(*) AS blocks FROM (SELECT rank, k FROM (SELECT rank, target, seats, unnest(range(1, ceil(target / total * seats)::BIGINT + 3)) AS k FROM tg) WHERE target > 0 QUALIFY row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) <= seats) GROUP BY 1),
per AS (SELECT tg.*, coalesce(blocks, 0) AS blocks, least(greatest(ceil(source_size / {M.SHARD_WORDS}), 1), {M.MAX_SHARDS})::BIGINT AS shards FROM tg LEFT JOIN won USING (rank)),
r AS MATERIALIZED (SELECT s.*, per.* EXCLUDE (source), ('0x' || substr(draw, 1, 7))::BIGINT % shards AS shard FROM s JOIN per ON s.source IS NOT DISTINCT FROM per.source),
sh AS (SELECT rank, shard, sum(size)::BIGINT AS words, any_value(blocks) AS blocks FROM r GROUP BY ALL),
q AS (SELECT rank, shard, count(*) AS quota FROM (SELECT rank, shard FROM (SELECT *, unnest(range(1, ceil(words::DOUBLE / (sum(words) OVER (PARTITION BY rank)) * blocks)::BIGINT + 3)) AS k FROM sh WHERE words > 0) QUALIFY row_number() OVER (PARTITION BY rank ORDER BY words / (2 * k - 1) DESC, shard) <= blocks) GROUP BY ALL),
p AS (SELECT r.*, sum(size) OVER (PARTITION BY r.rank, r.shard ORDER BY draw, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS hi, ceil(words / {M.BLOCK})::BIGINT AS n, least(coalesce(quota, 0), ceil(words / {M.BLOCK})::BIGINT * {M.MAX_REPEAT}) AS give, ('0x' || substr(md5('7|' || r.rank || '|' || r.shard), 1, 7))::BIGINT AS start_
  FROM r JOIN sh ON sh.rank = r.rank AND sh.shard = r.shard LEFT JOIN q ON q.rank = r.rank AND q.shard = r.shard),
b AS (SELECT *, give // n AS passes, give % n AS rest, hi - size AS lo FROM p WHERE size > 0)
SELECT id AS doc_id, size::BIGINT AS size, source_size, target, (size * passes + coalesce(list_sum(list_transform(range(lo // {M.BLOCK}, (hi - 1) // {M.BLOCK} + 1), lambda x: CASE WHEN (x * {M.STEP} + start_) % n < rest THEN least(hi, (x + 1) * {M.BLOCK}) - greatest(lo, x * {M.BLOCK}) ELSE 0 END)), 0))::BIGINT AS taken FROM b
UNION ALL SELECT id, size, source_size, target, 0 FROM r WHERE size = 0"""


def _found(pattern: str, kind: int, keep: str = "true", group: int = 0) -> str:
    """(id, start, kind, end, hit) of the matches of ``pattern``: positions are sums of the lengths between matches."""
    return f"""SELECT id, at_ AS start, {kind} AS kind, at_ + length(hit) AS end_, hit FROM (
  SELECT id, i, m[i] AS hit, g[i] AS grp, list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS at_ FROM (
    SELECT id, t, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_extract_all(t, {quoted(pattern)}, {group}) AS g, string_split_regex(t, {quoted(pattern)}) AS gap, unnest(range(1, len(regexp_extract_all(t, {quoted(pattern)})) + 1)) AS i FROM d WHERE regexp_matches(t, {quoted(pattern)}))) WHERE {keep}"""


def _secrets() -> str:
    allowed = " AND ".join(f"NOT regexp_matches(hit, {quoted(p)})" for p in X.ALLOW)
    high = " UNION ALL ".join(
        f"SELECT c.id, c.start + i - {k.width} AS lo, c.start + i AS hi, {n} AS class, c.start AS cand FROM (SELECT *, unnest(range({k.width}, length(hit) + 1)) AS i FROM ({_found(k.pattern, 3, allowed)})) c WHERE list_aggregate(string_split(substr(hit, i - {k.width - 1}, {k.width}), ''), 'entropy') >= {k.bits}"
        for n, k in enumerate(X.CLASSES))
    names = "['assign', 'access', 'hex', 'entropy']"
    say = lambda f: f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || end_, ',' ORDER BY start, kind, end_){f}, '')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (SELECT id, start, kind, end_ FROM ({_found(X.ASSIGN, 0, 'length(grp) >= 6', 2)}) UNION ALL SELECT id, start, kind, end_ FROM ({_found(X.ACCESS, 1)}) UNION ALL SELECT id, start, kind, end_ FROM ({_found(X.HEX, 2)})),
win AS ({high}),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY id, class, cand ORDER BY lo) AS grp FROM (SELECT *, CASE WHEN lo <= lag(hi) OVER (PARTITION BY id, class, cand ORDER BY lo) THEN 0 ELSE 1 END AS fresh FROM win)),
high AS (SELECT DISTINCT id, start, 3 AS kind, end_ FROM (SELECT id, class, cand, grp, min(lo) AS start, max(hi) AS end_ FROM isl GROUP BY ALL)),
free AS (SELECT h.* FROM high h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = h.id AND b.start < h.end_ AND h.start < b.end_)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM free)
SELECT d.id AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy, sha256({say(' FILTER (kind < 3)')}) AS base_sha256, {say('')} AS spans FROM d LEFT JOIN every e ON e.id = d.id GROUP BY d.id"""


ORACLE_SQL = {"op2_exact_dedup": EXACT, "op6_mixing": MIXING, "op8_warc": WARC, "op9_secrets": _secrets()}
