"""Search: several fields, weights, safe and tiered ranking, and the engine that ties them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import index, ranking

BM25_NAMES = {"okapibm25", "okapi bm25", "bm25"}


def weights_of(weights: object, fields: tuple[str, ...] = index.FIELDS) -> dict[str, float]:
    """A dict by field, or a list in order of ``fields`` padded with 0; anything else weighs all fields 1."""
    if isinstance(weights, dict):
        return {f: float(weights.get(f, 0.0)) for f in fields}
    if isinstance(weights, (list, tuple)):
        return {f: float(weights[i]) if i < len(weights) else 0.0 for i, f in enumerate(fields)}
    return dict.fromkeys(fields, 1.0)


def merge(*scores: DataFrame) -> DataFrame:
    """Full outer sum of scores per (query_id, field, doc_id)."""
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return out.groupBy("query_id", "field", "doc_id").agg(F.sum("score").alias("score"))


def aggregate(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum over fields; fields of weight 0 are not read, missing fields add 0."""
    used = {f: w for f, w in weights.items() if w}
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in used.items()]) if used else F.lit(0.0)
    return scores.where(F.col("field").isin(*used) if used else F.lit(False)).groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("score")).alias("score"))


def tiered(scores: DataFrame, least: int) -> DataFrame:
    """Scores of (query_id, field, tier, doc_id) summed over tiers, stopping once a query has ``least`` documents in any field.

    A tier without a new document is read too, up to the first that reaches the number.
    """
    new = scores.groupBy("query_id", "doc_id").agg(F.min("tier").alias("tier")).groupBy("query_id", "tier").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("query_id").orderBy("tier").rowsBetween(W.unboundedPreceding, 0))  # three rows a query
    reach = new.withColumn("upto", upto).where(F.col("upto") >= least).groupBy("query_id").agg(F.min("tier").alias("stop"))
    kept = scores.join(reach, "query_id", "left").where(F.col("stop").isNull() | (F.col("tier") <= F.col("stop")))
    return kept.groupBy("query_id", "field", "doc_id").agg(F.sum("score").alias("score"))


class SearchEngine:
    """Ranks batches of queries over an index of ``index.build``'s tables (lazy or read from disk)."""

    def __init__(self, tables: dict[str, DataFrame], documents: DataFrame | None = None, stem=T.suffix_stem):
        self.tables, self.documents, self.stem = tables, documents, stem

    def search(self, queries: DataFrame, k: int | None = 10, method: str = "ltn.lnn", weights: object = (0.3, 0.3, 0.4), safe: bool = True, smoothing: str | None = None, alpha: float = 0.5, lam: float = 0.5, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
        """(query_id, doc_id, score, rank).

        A smoothing method, or the method 'unigram', ranks by language model. BM25
        always reads the whole index; vector methods do unless ``safe`` is False.
        """
        w = weights_of(weights)
        t = {k: v.where(F.col("field").isin(*[f for f, x in w.items() if x])) for k, v in self.tables.items()}
        q = ranking.query_terms(queries, id_col, T.terms(F.col(text_col), self.stem))
        if smoothing or method.lower() == "unigram":
            if k is not None and k >= 0 and min(w.values()) >= 0:
                return ranking.language_top(t["postings"], q, t["doc_lengths"], k, smoothing or "mixture", alpha, lam, w)
            scores = ranking.language_model(t["postings"], q, t["doc_lengths"], smoothing or "mixture", alpha, lam)
        elif method.lower() in BM25_NAMES:
            scores = ranking.bm25(t["postings"].join(q.select("term").distinct(), "term", "left_semi"), q, t["doc_lengths"], t["field_stats"])
        elif safe:
            scores = ranking.vector_space(t["postings"].join(q.select("term").distinct(), "term", "left_semi"), q, t["field_stats"], method)
        else:
            posts = t["tiers"].join(q.select("term").distinct(), "term", "left_semi")
            scores = tiered(ranking.vector_space(posts, q, t["field_stats"], method, extra=("tier",)), k if k and k > 0 else 1 << 30)
        return ranking.top_k(aggregate(scores, w), k)

    def fetch(self, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """The documents of ``ranked``."""
        return ranked.join(self.documents.withColumnRenamed(id_col, "doc_id"), "doc_id")
