"""Retrieval metrics over runs (query_id, rank, doc_id) and judgments (query_id, doc_id, relevance).

Binary metrics follow one family of definitions (duplicates skipped in average
precision but counted again in gain), graded ones another (no duplicate handling,
gain 2^rel - 1). Both keep every query of the judgments, also without results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADED = ("precision_at_5", "precision_at_10", "recall_at_10", "recall_at_20", "map", "ndcg_at_5", "ndcg_at_10", "judged_coverage")


def length_check(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: the numbers of queries in both frames, and whether they are the same."""
    n = lambda t, name: t.agg(F.countDistinct("query_id").alias(name))
    return n(actual, "actual").crossJoin(n(predicted, "predicted")).withColumn("same", F.col("actual") == F.col("predicted"))


def same_length(actual: DataFrame, predicted: DataFrame) -> None:
    """Raise ValueError unless both frames have as many queries."""
    if not length_check(actual, predicted).first()["same"]:
        raise ValueError("actual and predicted must have the same length")


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _gain(n: Column) -> Column:
    """Ideal binary gain of n relevant documents."""
    n = n.cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))).otherwise(F.lit(0.0))


def binary_per_query(runs: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, precision, recall, ap, dcg, ndcg, rr); ``qrels`` (query_id, doc_id) lists relevant documents.

    ``queries`` (query_id) adds queries that have neither results nor judgments.
    """
    rel = qrels.select("query_id", "doc_id").distinct()
    first = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    hits = runs.select("query_id", "rank", "doc_id").join(rel.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left")
    hits = hits.withColumns({"rel": F.coalesce("rel", F.lit(0)), "first": first})
    hits = hits.withColumn("new", F.when(F.col("first"), F.col("rel")).otherwise(0))
    seen = F.sum("new").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    per = hits.withColumn("seen", seen).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_pred"), F.sum(F.col("first").cast("int")).alias("n_distinct"), F.sum("new").alias("found"),
        F.sum(F.when(F.col("new") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("aps"),
        F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("at"))
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    every = rel.select("query_id").union(runs.select("query_id"))
    every = (every.union(queries.select("query_id")) if queries is not None else every).distinct()
    t = every.join(per, "query_id", "left").join(n_rel, "query_id", "left").na.fill(0).na.fill(0.0)
    ideal = _gain(F.when(F.col("n_pred") > 0, F.least("n_rel", "n_pred")).otherwise(F.col("n_rel")))
    return t.select("query_id", _div(F.col("found"), F.col("n_distinct")).alias("precision"), _div(F.col("found"), F.col("n_rel")).alias("recall"), _div(F.col("aps"), F.col("n_rel")).alias("ap"), F.col("dcg"), _div(F.col("dcg"), ideal).alias("ndcg"), F.when(F.col("at") > 0, 1 / F.col("at")).otherwise(0.0).alias("rr"))


def evaluation(per_query: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 of the two means, ap, map, dcg, ndcg, rr, mrr."""
    m = per_query.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "ap", "dcg", "ndcg", "rr")])
    f1 = _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.select("precision", "recall", f1.alias("f1"), "ap", F.col("ap").alias("map"), "dcg", "ndcg", "rr", F.col("rr").alias("mrr"))


def graded_per_query(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(run_name, query_id, eight graded metrics); ``runs`` has run_name, query_id, rank, doc_id, and only its queries appear."""
    judged = qrels.select("query_id", "doc_id", "relevance")
    t = runs.select("run_name", "query_id", "rank", "doc_id").join(judged, ["query_id", "doc_id"], "left")
    t = t.withColumns({"known": F.col("relevance").isNotNull().cast("int"), "rel": F.coalesce("relevance", F.lit(0))}).withColumn("hit", (F.col("rel") > 0).cast("int"))
    t = t.withColumn("seen", F.sum("hit").over(W.partitionBy("run_name", "query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    upto = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0))
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    per = t.groupBy("run_name", "query_id").agg(
        *[upto(k, F.col("hit")).alias(f"h{k}") for k in (5, 10, 20)], *[upto(k, gain).alias(f"g{k}") for k in (5, 10)],
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("aps"), upto(20, F.col("known")).alias("known"), upto(20, F.lit(1)).alias("cut"))
    ideal = judged.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")))
    best = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("i") + 1.0)
    ideal = ideal.groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("int")).alias("n_rel"), *[F.sum(F.when(F.col("i") <= k, best).otherwise(0.0)).alias(f"i{k}") for k in (5, 10)])
    t = per.join(ideal, "query_id", "left").na.fill(0).na.fill(0.0)
    c = F.col
    return t.select("run_name", "query_id", (c("h5") / 5).alias("precision_at_5"), (c("h10") / 10).alias("precision_at_10"), _div(c("h10"), c("n_rel")).alias("recall_at_10"), _div(c("h20"), c("n_rel")).alias("recall_at_20"), _div(c("aps"), c("n_rel")).alias("map"), _div(c("g5"), c("i5")).alias("ndcg_at_5"), _div(c("g10"), c("i10")).alias("ndcg_at_10"), _div(c("known"), c("cut")).alias("judged_coverage"))


def report(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """Means by run and query type, and over all types; ``queries`` has query_id, query_type."""
    t = per_query.join(queries.select("query_id", "query_type"), "query_id")
    t = t.groupingSets([[F.col("run_name"), F.col("query_type")], [F.col("run_name")]], "run_name", "query_type").agg(F.grouping("query_type").alias("__g"), F.count(F.lit(1)).alias("num_queries"), *[F.avg(m).alias(m) for m in GRADED])
    return t.select("run_name", F.when(F.col("__g") == 1, "all").otherwise(F.col("query_type")).alias("query_type"), "num_queries", *GRADED)


def rank_by(results: DataFrame, score: str, name: str) -> DataFrame:
    """A run from scored results: rows with a score, by it and then by the rank they had."""
    t = results.where(F.col(score).isNotNull())
    order = W.partitionBy("query_id").orderBy(F.desc(score), F.coalesce("rank", F.lit(10**9)), "doc_id")
    return t.select(F.lit(name).alias("run_name"), "query_id", F.row_number().over(order).alias("rank"), "doc_id")


def five_runs(retrieval: DataFrame, reranked: DataFrame, strategy_a: DataFrame | None = None) -> DataFrame:
    """The runs that two result sets hold; runs that need text leave out image queries."""
    text, text_r = retrieval.where("query_type <> 'image'"), reranked.where("query_type <> 'image'")
    ce = rank_by(text_r, "cross_encoder_score", "hybrid_cross_encoder")
    if strategy_a is not None:
        given = strategy_a.where("query_type <> 'image'").select(F.lit("hybrid_cross_encoder").alias("run_name"), "query_id", "rank", "doc_id")
        ce = given.unionByName(ce.join(given.select("query_id").distinct(), "query_id", "left_anti").select(ce.columns))
    parts = [rank_by(retrieval, "dense_score", "dense_single_vector"), rank_by(text, "sparse_score", "sparse_splade"), rank_by(retrieval, "prefusion_score", "hybrid_prefusion"), ce, rank_by(reranked, "final_score", "hybrid_cross_encoder_fused")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_cases(per_query: DataFrame, pairs: dict[str, tuple[str, str, str]], metric: str = "ndcg_at_10") -> DataFrame:
    """(case, query_id, delta): ``pairs`` maps a case to (run, other run, 'max' or 'min'); ties go to the smallest query_id."""
    wide = per_query.groupBy("query_id").pivot("run_name", sorted({r for a, b, _ in pairs.values() for r in (a, b)})).agg(F.first(metric))
    out = None
    for case, (a, b, kind) in pairs.items():
        delta = F.coalesce(F.col(a), F.lit(0.0)) - F.coalesce(F.col(b), F.lit(0.0))
        order = F.desc("delta") if kind == "max" else F.asc("delta")
        one = wide.select(F.lit(case).alias("case"), "query_id", F.round(delta, 9).alias("delta")).orderBy(order, "query_id").limit(1)
        out = one if out is None else out.unionByName(one)
    return out


def error_lists(cases: DataFrame, before: DataFrame, after: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """(case, query_id, stage, rank, doc_id, relevance): the first ``k`` documents of each case before and after; unjudged ones have relevance null."""
    lists = before.select("query_id", "rank", "doc_id", F.lit("before").alias("stage")).unionByName(after.select("query_id", "rank", "doc_id", F.lit("after").alias("stage")))
    t = cases.select("case", "query_id").join(lists.where(F.col("rank") <= k), "query_id")
    return t.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").select("case", "query_id", "stage", "rank", "doc_id", "relevance")


def rank_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, doc_id, before, after, shift) of documents in both runs; a positive shift is a rise."""
    b = before.select("query_id", "doc_id", F.col("rank").alias("before"))
    return b.join(after.select("query_id", "doc_id", F.col("rank").alias("after")), ["query_id", "doc_id"]).withColumn("shift", F.col("before") - F.col("after"))


def top_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: queries, queries whose first document changed, and pool sizes of ``before``."""
    first = lambda t, n: t.where("rank = 1").select("query_id", F.col("doc_id").alias(n))
    size = before.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    t = size.join(first(before, "b"), "query_id", "left").join(first(after, "a"), "query_id", "left")
    return t.agg(F.count(F.lit(1)).alias("queries"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("int")).alias("top_changed"), F.min("n").alias("min_pool"), F.max("n").alias("max_pool"), F.avg("n").alias("mean_pool"))


def accuracy(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    return df.agg(F.avg(F.col(predicted).eqNullSafe(F.col(expected)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def acceptance(df: DataFrame, by: str = "model", status: str = "status") -> DataFrame:
    """Counts of direct, repaired and fallback answers by model."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(status) == s).alias(s) for s in ("direct", "repair", "fallback")])


def mean_loss(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


def representatives(queries: DataFrame) -> DataFrame:
    """(kind, query_id): the first query of each type, and the first whose text excludes something."""
    from corvane.functions.text import has_negation

    by_type = queries.groupBy(F.col("query_type").alias("kind")).agg(F.min("query_id").alias("query_id"))
    negated = queries.where(has_negation(F.col("query_text"))).agg(F.min("query_id").alias("query_id")).where("query_id is not null")
    return by_type.unionByName(negated.select(F.lit("negation").alias("kind"), "query_id"))
