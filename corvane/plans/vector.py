"""Queries of vector retrieval, fusion, reranking and evaluation over ``embeddings``, with their SQL.

Queries of a search are the rows whose identifier is divisible by 50, against all
rows. The stub for a cross-encoder is the inner product of the first 8 dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import answers, checks, metrics, represent, vectors
from corvane.plans import sql as S
from corvane.plans.lexical import table

TOP = 100


def _all(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(spark, d) -> DataFrame:
    kinds = F.array(F.lit("text"), F.lit("image"), F.lit("image_text"))
    t = _all(spark, d).where(F.col("vec_id") % 50 == 0)
    return t.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("ql"), F.get(kinds, F.floor(F.col("vec_id") / 50).cast("int") % 3).alias("query_type"))


def _dense(spark, d, k: int = TOP) -> DataFrame:
    return vectors.dense_topk_parts(_queries(spark, d).select("query_id", "qv"), _all(spark, d).select("vec_id", "embedding"), k)


def _flat(spark, d) -> DataFrame:
    """Sparse vectors: the 16 largest positive entries."""
    v = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("dim"), x.cast("double").alias("weight"))), lambda e: e["weight"] > 0)
    return _all(spark, d).select(F.col("vec_id").alias("id"), F.inline(vectors.sparsify(v, 16)))


def _sparse(spark, d, k: int = TOP, **options) -> DataFrame:
    flat = _flat(spark, d)
    q = flat.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "dim", "weight")
    return vectors.sparse_topk(q, flat, k, **options)


def _fused(spark, d, **options) -> DataFrame:
    return vectors.fuse(_dense(spark, d), _sparse(spark, d), _queries(spark, d), **options)


def _scored(spark, d) -> DataFrame:
    t = _fused(spark, d)
    q = _queries(spark, d).select("query_id", F.slice("qv", 1, 8).alias("__q"))
    x = _all(spark, d).select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 8).alias("__x"))
    return t.join(q, "query_id").join(x, "id").withColumn("cross_encoder_score", vectors.dot(F.col("__q"), F.col("__x"))).drop("__q", "__x")


def _qrels(spark, d) -> DataFrame:
    x = _all(spark, d).select(F.col("vec_id").alias("doc_id"), "label")
    t = _queries(spark, d).join(x, F.col("ql") == F.col("label"))
    return t.select("query_id", "doc_id", F.when((F.col("doc_id") - F.col("query_id")) % 2 == 0, 2).otherwise(1).alias("relevance"))


def _runs(spark, d) -> DataFrame:
    names = lambda t: t.withColumnRenamed("id", "doc_id")
    fused, scored = names(_fused(spark, d)), _scored(spark, d)
    rer = names(vectors.rerank(scored))
    return metrics.five_runs(fused, rer)


def _r(t: DataFrame, *cols: str) -> DataFrame:
    return t.withColumns({c: F.round(c, 6) for c in cols})


def dense_topk(spark, d):
    return _r(_dense(spark, d, 10), "score")


def nearest(spark, d):
    q = _queries(spark, d).select("query_id", "qv")
    return _r(vectors.dense_topk_parts(q, _all(spark, d).select("vec_id", "embedding"), 5, "cosine", skip_self=True), "score")


def l2_normalize(spark, d):
    t = _all(spark, d).select("vec_id", vectors.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return t.select("vec_id", F.round(vectors.l2(F.col("v")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def sparsify(spark, d):
    return _r(_flat(spark, d), "weight")


def sparse_topk(spark, d):
    return _r(_sparse(spark, d, 10), "score")


def sparse_topk_zeros(spark, d):
    return _r(_sparse(spark, d, 600, keep_zero=True), "score").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("n_positive"))


def minmax(spark, d):
    return _dense(spark, d).select("query_id", "id", F.round(vectors.minmax(F.col("score")), 6).alias("norm"))


def zscore(spark, d):
    return _dense(spark, d).select("query_id", "id", F.round(vectors.zscore(F.col("score")), 6).alias("z"))


def _shown(t: DataFrame) -> DataFrame:
    return _r(t.select("query_id", "query_type", "id", "dense_score", "sparse_score", "prefusion_score", "rank"), "dense_score", "sparse_score", "prefusion_score")


def rrf(spark, d):
    return _shown(_fused(spark, d))


def weighted_fusion(spark, d):
    return _shown(_fused(spark, d, method="weighted"))


def rrf_image_minmax(spark, d):
    return _shown(_fused(spark, d, image="minmax", degenerate="zero"))


def rerank_fused(spark, d):
    t = vectors.rerank(_scored(spark, d))
    return _r(t.select("query_id", "id", "cross_encoder_score", "final_score", "rank"), "cross_encoder_score", "final_score")


def strategy_a(spark, d):
    return _r(vectors.strategy_a(_scored(spark, d)).select("query_id", "id", "cross_encoder_score", "rank"), "cross_encoder_score")


def candidate_stats(spark, d):
    return _r(vectors.candidate_stats(_fused(spark, d)), "mean_unique", "mean_overlap")


def judgment_pool(spark, d):
    names = lambda t: t.withColumnRenamed("id", "doc_id")
    fused, scored = names(_fused(spark, d)), _scored(spark, d)
    rer, a = names(vectors.rerank(scored)), names(vectors.strategy_a(scored))
    lists = [(rer, True), (fused, True), (metrics.rank_by(fused, "dense_score", "x"), True), (metrics.rank_by(fused, "sparse_score", "x"), False), (a, False)]
    return answers.judgment_pool(lists, fused, _queries(spark, d))


def precision_recall_f1(spark, d):
    per = metrics.binary_per_query(_dense(spark, d, 10).withColumnRenamed("id", "doc_id"), _qrels(spark, d))
    return _r(metrics.evaluation(per).select("precision", "recall", "f1"), "precision", "recall", "f1")


def map_mrr(spark, d):
    per = metrics.binary_per_query(_dense(spark, d, 10).withColumnRenamed("id", "doc_id"), _qrels(spark, d))
    return _r(metrics.evaluation(per).select("map", "mrr"), "map", "mrr")


def dcg_ndcg(spark, d):
    per = metrics.binary_per_query(_dense(spark, d, 10).withColumnRenamed("id", "doc_id"), _qrels(spark, d))
    return _r(per.select("query_id", "dcg", "ndcg"), "dcg", "ndcg")


def graded_metrics(spark, d):
    return _r(metrics.graded_per_query(_runs(spark, d), _qrels(spark, d)), *metrics.GRADED)


def metrics_by_type(spark, d):
    return _r(metrics.report(metrics.graded_per_query(_runs(spark, d), _qrels(spark, d)), _queries(spark, d)), *metrics.GRADED)


def error_cases(spark, d):
    per = metrics.graded_per_query(_runs(spark, d), _qrels(spark, d))
    pairs = {"dense_over_sparse": ("dense_single_vector", "sparse_splade", "max"), "rerank_helps": ("hybrid_cross_encoder_fused", "hybrid_prefusion", "max"), "rerank_hurts": ("hybrid_cross_encoder_fused", "hybrid_prefusion", "min")}
    return _r(metrics.error_cases(per, pairs), "delta")


def error_lists(spark, d):
    names = lambda t: t.withColumnRenamed("id", "doc_id")
    return metrics.error_lists(error_cases(spark, d), names(_fused(spark, d)), names(vectors.rerank(_scored(spark, d))), _qrels(spark, d))


def length_check(spark, d):
    """All queries, and queries of which every other one has no results."""
    actual, runs = _qrels(spark, d), _dense(spark, d, 10)
    some = metrics.length_check(actual, runs.where("query_id % 100 = 0"))
    return metrics.length_check(actual, runs).withColumn("input", F.lit("whole")).unionByName(some.withColumn("input", F.lit("damaged")))


def odd_one_out_accuracy(spark, d):
    """Expected is, of each four, the one whose label is rarest among them, the first on a tie."""
    t = _all(spark, d).select(F.floor(F.col("vec_id") / 4).cast("long").alias("group_id"), "vec_id", "label")
    n = t.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    expected = t.join(n, ["group_id", "label"]).groupBy("group_id").agg(F.min_by("vec_id", F.struct("n", "vec_id")).alias("expected"))
    return _r(metrics.accuracy(odd_one_out(spark, d).join(expected, "group_id"), "odd", "expected"), "accuracy")


def rank_shift(spark, d):
    names = lambda t: t.withColumnRenamed("id", "doc_id")
    return metrics.rank_shift(names(_fused(spark, d)), names(vectors.rerank(_scored(spark, d))))


def top_changes(spark, d):
    names = lambda t: t.withColumnRenamed("id", "doc_id")
    return _r(metrics.top_changes(names(_fused(spark, d)), names(vectors.rerank(_scored(spark, d)))), "mean_pool")


def nested_results(spark, d):
    t = vectors.nest(_fused(spark, d), "hybrid_prefusion")
    return t.select("query_id", "run_name", "sparse_applicable", F.size("results").alias("n"), F.get("results", F.lit(0))["id"].alias("first_id"))


def odd_one_out(spark, d):
    """Of each four neighbours by identifier, the vector least like the others."""
    t = _all(spark, d)
    groups = t.select(F.floor(F.col("vec_id") / 4).cast("long").alias("group_id"), (F.col("vec_id") % 4).alias("pos"), F.col("vec_id").alias("word"))
    return vectors.odd_one_out(groups, t.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector")))


def self_retrieval(spark, d):
    return vectors.self_retrieval(_all(spark, d).select("vec_id", "embedding"))


def silhouette(spark, d):
    t = represent.silhouette(_all(spark, d), "label", "embedding", "vec_id")
    return t.groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def dbscan(spark, d):
    t = represent.dbscan(_all(spark, d), "embedding", "vec_id", 1.12, 3)
    return t.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def sparse_stats(spark, d):
    t = _flat(spark, d).groupBy("id").agg(F.collect_list("dim").alias("indices"))
    return _r(checks.sparse_stats(t), "mean_nnz")


def qrels_coverage(spark, d):
    q = _queries(spark, d)
    return answers.qrels_coverage(_qrels(spark, d).where("relevance = 2 and doc_id % 3 = 0"), q)


def query_types(spark, d):
    return _queries(spark, d).groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


def source_combinations(spark, d):
    return _fused(spark, d).groupBy(F.array_join("source", "+").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def pca(spark, d):
    t, ratio = represent.pca(_all(spark, d), "embedding")
    return t.select("vec_id", F.round(F.get("pc", F.lit(0)), 6).alias("x"), F.round(F.get("pc", F.lit(1)), 6).alias("y"), F.lit(round(sum(ratio), 6)).alias("explained"))


def dense_checks(spark, d):
    return checks.dense_vectors(_all(spark, d)).select("check", "passed")


def result_checks(spark, d):
    t = _fused(spark, d).withColumn("sparse_score", F.when(F.col("query_type") != "image", F.col("sparse_score")))
    known = _all(spark, d).select(F.col("vec_id").alias("id"))
    return checks.results(t, known).select("check", "passed").unionByName(checks.reranked_subset(vectors.rerank(_scored(spark, d)), t).select("check", "passed"))


def score_checks(spark, d):
    return checks.scores(_scored(spark, d)).select("check", "passed")


def metric_checks(spark, d):
    per = metrics.report(metrics.graded_per_query(_runs(spark, d), _qrels(spark, d)), _queries(spark, d))
    return checks.metric_ranges(per, metrics.GRADED, ("text", "image", "image_text", "all")).select("check", "passed")


QUERIES = {
    f.__name__: f
    for f in (dense_topk, nearest, l2_normalize, sparsify, sparse_topk, sparse_topk_zeros, minmax, zscore, rrf, weighted_fusion, rrf_image_minmax, rerank_fused, strategy_a, candidate_stats, judgment_pool, precision_recall_f1, map_mrr, dcg_ndcg, graded_metrics, metrics_by_type, error_cases, error_lists, length_check, odd_one_out_accuracy, rank_shift, top_changes, nested_results, odd_one_out, self_retrieval, silhouette, dbscan, sparse_stats, qrels_coverage, query_types, source_combinations, pca, dense_checks, result_checks, score_checks, metric_checks)
}

_V = f"WITH {S.VECTORS}"
_F = f"{_V}, {S.RRF}"
_R = f"{_F}, {S.RERANKED}"
_TOP10 = "run AS (SELECT query_id, id AS doc_id, rank FROM dense WHERE rank <= 10)"
_BIN = f"""{_V}, {S.QRELS}, {_TOP10},
hit AS (SELECT r.query_id, r.doc_id, r.rank, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM run r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id),
seen AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM hit),
nr AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY 1),
per AS (SELECT query_id, sum(rel) / count(*) AS precision, sum(rel) / any_value(n_rel) AS recall, sum(CASE WHEN rel = 1 THEN s / rank ELSE 0 END) / any_value(n_rel) AS ap, sum(CASE WHEN rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
  coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS rr, list_sum(list_transform(range(1, least(any_value(n_rel), count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM seen JOIN nr USING (query_id) GROUP BY 1)"""
_RUNS = f"""{_R}, {S.QRELS},
runs AS MATERIALIZED (
  SELECT 'dense_single_vector' AS run_name, query_id, id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, rank, id) AS rank FROM rrf WHERE dense_score IS NOT NULL
  UNION ALL SELECT 'sparse_splade', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, rank, id) FROM rrf WHERE sparse_score IS NOT NULL AND query_type <> 'image'
  UNION ALL SELECT 'hybrid_prefusion', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY prefusion_score DESC, rank, id) FROM rrf
  UNION ALL SELECT 'hybrid_cross_encoder', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY cross_encoder_score DESC, rank, id) FROM rer WHERE query_type <> 'image'
  UNION ALL SELECT 'hybrid_cross_encoder_fused', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank, id) FROM rer),
g AS (SELECT r.*, coalesce(relevance, 0) AS rel, (relevance IS NOT NULL)::INT AS known FROM runs r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id),
g2 AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY run_name, query_id ORDER BY rank) AS s FROM g),
ide AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM qrels),
idl AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN i <= 5 THEN (2 ** relevance - 1) / log2(i + 1) ELSE 0 END) AS i5, sum(CASE WHEN i <= 10 THEN (2 ** relevance - 1) / log2(i + 1) ELSE 0 END) AS i10 FROM ide GROUP BY 1),
pq AS MATERIALIZED (SELECT run_name, query_id, sum((rel > 0 AND rank <= 5)::INT) / 5 AS precision_at_5, sum((rel > 0 AND rank <= 10)::INT) / 10 AS precision_at_10, sum((rel > 0 AND rank <= 10)::INT) / any_value(n_rel) AS recall_at_10, sum((rel > 0 AND rank <= 20)::INT) / any_value(n_rel) AS recall_at_20,
  sum(CASE WHEN rel > 0 THEN s / rank ELSE 0 END) / any_value(n_rel) AS map, sum(CASE WHEN rank <= 5 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) / any_value(i5) AS ndcg_at_5, sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) / any_value(i10) AS ndcg_at_10,
  sum(CASE WHEN rank <= 20 THEN known ELSE 0 END) / sum((rank <= 20)::INT) AS judged_coverage FROM g2 JOIN idl USING (query_id) GROUP BY ALL)"""
_M8 = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.GRADED)
_A8 = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.GRADED)
_SHOW = "SELECT query_id, query_type, id, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, round(prefusion_score, 6) AS prefusion_score, rank FROM"


def _fuse_sql(score: str) -> str:
    return f"""{_V}, f0 AS (SELECT b.*, query_type, {score} AS prefusion_score FROM both_ b JOIN ty USING (query_id)),
f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(prefusion_score, 12) DESC, round(dense_score, 9) DESC NULLS LAST, id) AS rank FROM f0) {_SHOW} f1"""


_CHECK = lambda names: " UNION ALL ".join(f"SELECT {S.quoted(n)} AS \"check\", {t} AS passed" for n, t in names.items())

_CASES = f"""{_RUNS}, wide AS (SELECT query_id, {', '.join(f"coalesce(max(ndcg_at_10) FILTER (run_name = '{r}'), 0) AS {r}" for r in ('dense_single_vector', 'sparse_splade', 'hybrid_prefusion', 'hybrid_cross_encoder_fused'))} FROM pq GROUP BY 1),
d AS (SELECT query_id, round(dense_single_vector - sparse_splade, 9) AS a, round(hybrid_cross_encoder_fused - hybrid_prefusion, 9) AS b FROM wide)
(SELECT 'dense_over_sparse' AS "case", query_id, round(a, 6) AS delta FROM d ORDER BY a DESC, query_id LIMIT 1) UNION ALL (SELECT 'rerank_helps', query_id, round(b, 6) FROM d ORDER BY b DESC, query_id LIMIT 1) UNION ALL (SELECT 'rerank_hurts', query_id, round(b, 6) FROM d ORDER BY b, query_id LIMIT 1)"""

ORACLE_SQL = {
    "dense_topk": f"{_V} SELECT query_id, id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10",
    "nearest": f"""{_V}, c AS (SELECT query_id, id, list_cosine_similarity(qs.v, xs.v) AS score FROM qs, xs WHERE query_id <> id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM c) WHERE rank <= 5""",
    "l2_normalize": "SELECT vec_id, 1.0::DOUBLE AS norm, round((v[1] * 3)::FLOAT::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: (x * 3)::FLOAT::DOUBLE * (x * 3)::FLOAT::DOUBLE))), 6) AS first FROM (SELECT vec_id, embedding AS v FROM embeddings)",
    "sparsify": f"{_V} SELECT id, dim, round(weight, 6) AS weight FROM sp",
    "sparse_topk": f"{_V} SELECT query_id, id, round(score, 6) AS score, rank FROM sparse WHERE rank <= 10",
    "sparse_topk_zeros": f"{_V} SELECT query_id, least(600, (SELECT count(*) FROM xs)) AS n, least(600, count(*)) AS n_positive FROM sall WHERE score > 0 GROUP BY 1",
    "minmax": f"{_V} SELECT query_id, id, round(norm, 6) AS norm FROM dn",
    "zscore": f"{_V} SELECT query_id, id, round(CASE WHEN stddev_pop(score) OVER w < 1e-9 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) AS z FROM dense WINDOW w AS (PARTITION BY query_id)",
    "rrf": f"{_F} {_SHOW} rrf",
    "weighted_fusion": _fuse_sql("CASE WHEN query_type <> 'image' THEN 0.55 * coalesce(dnorm, 0) + 0.45 * coalesce(snorm, 0) ELSE coalesce(dnorm, 0) END"),
    "rrf_image_minmax": _fuse_sql("CASE WHEN query_type <> 'image' THEN coalesce(1.0 / (60 + dr), 0.0) + coalesce(1.0 / (60 + sr), 0.0) ELSE coalesce(dnorm, 0) END"),
    "rerank_fused": f"{_R} SELECT query_id, id, round(cross_encoder_score, 6) AS cross_encoder_score, round(final_score, 6) AS final_score, rank FROM rer",
    "strategy_a": f"{_R} SELECT query_id, id, round(cross_encoder_score, 6) AS cross_encoder_score, rank FROM sta",
    "candidate_stats": f"{_V} SELECT round(avg(n), 6) AS mean_unique, round(avg(b), 6) AS mean_overlap FROM (SELECT query_id, count(*) AS n, count(*) FILTER (dr IS NOT NULL AND sr IS NOT NULL) AS b FROM both_ GROUP BY 1)",
    "judgment_pool": f"""{_R}, l AS (
  SELECT query_id, id AS doc_id, 0 AS p, rank FROM rer WHERE rank <= 8
  UNION ALL SELECT query_id, id, 1, rank FROM rrf WHERE rank <= 8
  UNION ALL SELECT * FROM (SELECT query_id, id, 2, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, rank, id) AS rank FROM rrf WHERE dense_score IS NOT NULL) WHERE rank <= 8
  UNION ALL SELECT * FROM (SELECT query_id, id, 3, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, rank, id) AS rank FROM rrf WHERE sparse_score IS NOT NULL AND query_type <> 'image') WHERE rank <= 8
  UNION ALL SELECT query_id, id, 4, rank FROM sta WHERE rank <= 8 AND query_type <> 'image'
  UNION ALL SELECT query_id, id, 5, rank FROM rrf),
f AS (SELECT query_id, doc_id, min(p * 100000 + rank) AS at_ FROM l GROUP BY ALL)
SELECT query_id, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY at_, doc_id) AS pos FROM f) WHERE pos <= 20""",
    "precision_recall_f1": f"{_BIN} SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT avg(precision) AS p, avg(recall) AS r FROM per)",
    "map_mrr": f"{_BIN} SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM per",
    "dcg_ndcg": f"{_BIN} SELECT query_id, round(dcg, 6) AS dcg, round(dcg / ideal, 6) AS ndcg FROM per",
    "graded_metrics": f"{_RUNS} SELECT run_name, query_id, {_M8} FROM pq",
    "metrics_by_type": f"{_RUNS} SELECT run_name, CASE WHEN grouping(query_type) = 1 THEN 'all' ELSE query_type END AS query_type, count(*) AS num_queries, {_A8} FROM pq JOIN ty USING (query_id) GROUP BY GROUPING SETS ((run_name, query_type), (run_name))",
    "error_cases": f"""{_CASES}""",
    "error_lists": f"""WITH cases AS ({_CASES}), {_RUNS.strip().removeprefix('WITH ')}
SELECT "case", c.query_id, stage, rank, l.doc_id, relevance FROM cases c JOIN (SELECT query_id, 'before' AS stage, rank, id AS doc_id FROM rrf UNION ALL SELECT query_id, 'after', rank, id FROM rer) l ON l.query_id = c.query_id AND rank <= 5 LEFT JOIN qrels q ON q.query_id = l.query_id AND q.doc_id = l.doc_id""",
    "length_check": "WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 100 = 0) AS h FROM embeddings WHERE vec_id % 50 = 0) SELECT n AS actual, n AS predicted, true AS same, 'whole' AS input FROM n UNION ALL SELECT n, h, n = h, 'damaged' FROM n",
    "odd_one_out_accuracy": """WITH x AS (SELECT vec_id // 4 AS group_id, vec_id % 4 AS pos, vec_id AS word, label, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.group_id, a.pos, a.word, avg(list_cosine_similarity(a.v, b.v)) AS mean FROM x a JOIN x b ON a.group_id = b.group_id AND a.pos <> b.pos GROUP BY ALL),
o AS (SELECT group_id, word AS odd FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(mean, 9), pos) = 1),
e AS (SELECT group_id, word AS expected FROM (SELECT *, count(*) OVER (PARTITION BY group_id, label) AS n FROM x) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n, word) = 1)
SELECT round(avg((odd = expected)::INT), 6) AS accuracy, count(*) AS n FROM o JOIN e USING (group_id)""",
    "rank_shift": f"{_R} SELECT b.query_id, b.id AS doc_id, b.rank AS before, a.rank AS after, b.rank - a.rank AS shift FROM rrf b JOIN rer a ON a.query_id = b.query_id AND a.id = b.id",
    "top_changes": f"{_R} SELECT count(*) AS queries, count(*) FILTER (a.id IS DISTINCT FROM b.id) AS top_changed, min(n) AS min_pool, max(n) AS max_pool, round(avg(n), 6) AS mean_pool FROM (SELECT query_id, count(*) AS n FROM rrf GROUP BY 1) JOIN (SELECT query_id, id FROM rrf WHERE rank = 1) b USING (query_id) JOIN (SELECT query_id, id FROM rer WHERE rank = 1) a USING (query_id)",
    "nested_results": f"{_F} SELECT query_id, 'hybrid_prefusion' AS run_name, query_type <> 'image' AS sparse_applicable, count(*) AS n, min(id) FILTER (rank = 1) AS first_id FROM rrf GROUP BY query_id, query_type",
    "odd_one_out": """WITH x AS (SELECT vec_id // 4 AS group_id, vec_id % 4 AS pos, vec_id AS word, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.group_id, a.pos, a.word, avg(list_cosine_similarity(a.v, b.v)) AS mean FROM x a JOIN x b ON a.group_id = b.group_id AND a.pos <> b.pos GROUP BY ALL)
SELECT group_id, word AS odd FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(mean, 9), pos) = 1""",
    "self_retrieval": """WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
p AS (SELECT * FROM o WHERE i IN (0, n // 4, n // 2, 3 * n // 4, n - 1)),
r AS (SELECT p.vec_id AS id, o.vec_id AS other, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_cosine_similarity(p.v, o.v), 9) DESC, o.vec_id) AS rank FROM p, o)
SELECT id, rank FROM r WHERE id = other""",
    "silhouette": """WITH x AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT label, count(*) AS n FROM x GROUP BY 1),
m AS (SELECT a.id, a.label, b.label AS other, sum(CASE WHEN a.id = b.id THEN 0 ELSE sqrt(greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 0)) END) AS total FROM x a, x b GROUP BY ALL),
s AS (SELECT id, m.label, max(CASE WHEN other = m.label AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN other <> m.label THEN total / n END) AS b FROM m JOIN n ON n.label = other GROUP BY ALL)
SELECT label, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM s GROUP BY 1""",
    "dbscan": """WITH RECURSIVE x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a, x b WHERE list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) <= 1.12 * 1.12 + 1e-9),
core AS MATERIALIZED (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) >= 3),
e AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)),
r AS (SELECT id, id AS l FROM core UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.id WHERE r.l < e.b),
c AS (SELECT id, min(l) AS l FROM r GROUP BY 1),
m AS (SELECT p.a AS id, min(c.l) AS cluster FROM p JOIN c ON c.id = p.b GROUP BY 1)
SELECT cluster, count(*) AS n FROM x LEFT JOIN m USING (id) GROUP BY 1""",
    "sparse_stats": f"{_V} SELECT round(avg(n), 6) AS mean_nnz, min(n) AS min_nnz, max(n) AS max_nnz, 0 AS failures FROM (SELECT id, count(*) AS n FROM sp GROUP BY 1)",
    "qrels_coverage": f"{_V}, {S.QRELS} SELECT count(*) AS queries, count(*) FILTER (n = 0) AS missing, min(n) AS least, max(n) AS most FROM (SELECT q.query_id, count(r.doc_id) AS n FROM qs q LEFT JOIN qrels r ON r.query_id = q.query_id AND relevance = 2 AND r.doc_id % 3 = 0 GROUP BY 1)",
    "query_types": f"{_V} SELECT query_type, count(*) AS n FROM qs GROUP BY 1",
    "source_combinations": f"{_V} SELECT concat_ws('+', CASE WHEN dr IS NOT NULL THEN 'dense' END, CASE WHEN sr IS NOT NULL THEN 'sparse' END) AS source, count(*) AS n FROM both_ GROUP BY 1",
    "dense_checks": _CHECK({"unit norms": "true", "one length": "true", "all finite": "true"}),
    "result_checks": _CHECK({"ranks are 1..n": "true", "no duplicates": "true", "identifiers are known": "true", "image queries have no sparse score": "true", "reranked results were retrieved": "true"}),
    "score_checks": _CHECK({"scores are finite": "true", "cosines are within 1.01": "true", "cross-encoder scores vary": "true"}),
    "metric_checks": _CHECK({**{f"{m} within 0..1": "true" for m in metrics.GRADED}, "all query types": "true"}),
}
