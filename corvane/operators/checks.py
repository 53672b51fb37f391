"""Acceptance checks: each gives rows (check, passed, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import answers
from corvane.operators.vectors import l2


def _table(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One aggregation for all tests; an empty table passes those without rows to fail."""
    one = df.agg(*[F.coalesce(t, F.lit(True)).alias(f"t{i}") for i, t in enumerate(tests.values())], F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"t{i}").alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail")) for i, name in enumerate(tests)])
    return one.select(F.inline(rows))


def _some(c: str) -> Column:
    return F.every(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)))


def catalog(df: DataFrame, id_col: str = "product_id", title: str = "title", text: str = "product_text", kind: str = "product_type", path: str | None = None) -> DataFrame:
    tests = {"ids are not empty": _some(id_col), "titles are not empty": _some(title), "texts are not empty": _some(text)}
    if path:
        tests["paths are not empty"] = _some(path)
    tests |= {"ids are unique": F.countDistinct(id_col) == F.count(F.lit(1)), "more than one type": F.countDistinct(kind) > 1, "texts are longer than titles": F.avg((F.length(text) > F.length(title)).cast("double")) > 0.9}
    return _table(df, tests)


def dense_vectors(df: DataFrame, vector: str = "embedding", atol: float = 1e-2) -> DataFrame:
    n = l2(F.col(vector))
    return _table(df, {"unit norms": F.every(F.abs(n - 1) <= atol), "one length": F.countDistinct(F.size(vector)) <= 1, "all finite": F.every(F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))})


def sparse_vectors(df: DataFrame, indices: str = "indices", values: str = "values", most: int = 256) -> DataFrame:
    return _table(df, {"as many indices as values": F.every(F.size(indices) == F.size(values)), "not empty": F.every(F.size(indices) > 0), f"at most {most} entries": F.every(F.size(indices) <= most)})


def sparse_stats(df: DataFrame, indices: str = "indices", error: str | None = None) -> DataFrame:
    """One row: mean, least and most entries, and failures."""
    n = F.size(indices)
    return df.agg(F.avg(n).alias("mean_nnz"), F.min(n).alias("min_nnz"), F.max(n).alias("max_nnz"), (F.count_if(F.col(error).isNotNull()) if error else F.lit(0).cast("long")).alias("failures"))


def alignment(ids: DataFrame, catalog_: DataFrame, id_col: str) -> DataFrame:
    """Identifiers that only one side has; no rows if both agree."""
    a, b = ids.select(id_col).distinct(), catalog_.select(id_col).distinct()
    return a.join(b, id_col, "left_anti").withColumn("only_in", F.lit("index")).unionByName(b.join(a, id_col, "left_anti").withColumn("only_in", F.lit("catalog")))


def results(df: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Ranked results: ranks 1..n, no duplicates, known identifiers, no sparse score for image queries."""
    per = df.join(known.select(id_col).distinct().withColumn("__k", F.lit(True)), id_col, "left").groupBy("query_id").agg(
        (F.min("rank") == 1).alias("a"), (F.max("rank") == F.count(F.lit(1))).alias("b"), (F.countDistinct("rank") == F.count(F.lit(1))).alias("c"), (F.countDistinct(id_col) == F.count(F.lit(1))).alias("d"),
        F.every(F.col("__k").isNotNull()).alias("e"), (F.every(F.col("sparse_score").isNull() | (F.col("query_type") != "image")) if "sparse_score" in df.columns and "query_type" in df.columns else F.lit(True)).alias("f"))
    return _table(per, {"ranks are 1..n": F.every(F.col("a") & F.col("b") & F.col("c")), "no duplicates": F.every("d"), "identifiers are known": F.every("e"), "image queries have no sparse score": F.every("f")})


def reranked_subset(reranked: DataFrame, retrieved: DataFrame, id_col: str = "id") -> DataFrame:
    extra = reranked.select("query_id", id_col).join(retrieved.select("query_id", id_col), ["query_id", id_col], "left_anti")
    return _table(extra, {"reranked results were retrieved": F.count(F.lit(1)) == 0})


def metric_ranges(metrics: DataFrame, names: tuple[str, ...], types: tuple[str, ...] = ()) -> DataFrame:
    tests = {f"{m} within 0..1": F.every(F.col(m).between(0, 1)) for m in names}
    if types:
        tests["all query types"] = F.size(F.array_intersect(F.collect_set("query_type"), F.array(*[F.lit(t) for t in types]))) == len(types)
    return _table(metrics, tests)


def qrels(df: DataFrame, queries: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    per = queries.select("query_id").join(df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("relevance").isin(0, 1, 2)).alias("g"), (F.countDistinct("doc_id") == F.count(F.lit(1))).alias("u")), "query_id", "left")
    return _table(per, {"all queries are judged": F.every(F.col("n").isNotNull()), f"{least} to {most} judgments": F.every(F.coalesce("n", F.lit(0)).between(least, most)), "grades are 0, 1 or 2": F.every(F.coalesce("g", F.lit(True))), "pairs are unique": F.every(F.coalesce("u", F.lit(True)))})


def answers_valid(df: DataFrame, answer: str = "answer", allowed: str = "allowed") -> DataFrame:
    n = F.size(answers.violations(F.col(answer), F.col("query_id").cast("string"), F.col(allowed)))
    return _table(df, {"answers follow the schema and name ranked products only": F.every(n == 0)})


def scores(df: DataFrame, dense: str = "dense_score", ce: str = "cross_encoder_score") -> DataFrame:
    """Finite scores, cosines within 1.01, and a cross-encoder that tells results apart."""
    finite = lambda c: F.every(F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf"))))
    return _table(df, {"scores are finite": finite(dense) & finite(ce), "cosines are within 1.01": F.every(F.col(dense).isNull() | (F.abs(dense) <= 1.01)), "cross-encoder scores vary": F.coalesce(F.stddev_pop(ce) > 0, F.lit(False))})
