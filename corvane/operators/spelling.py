"""Spelling correction by character k-grams and word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T


def vocabulary(docs: DataFrame, *texts: Column) -> DataFrame:
    """(word, cnt) over all ``texts`` of all rows."""
    both = F.concat(*[T.words(t) for t in texts])
    return docs.select(F.explode(both).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def grams(vocab: DataFrame, k: int = 2) -> DataFrame:
    """(word, gram)."""
    return vocab.select("word", F.explode(T.kgrams(F.col("word"), k)).alias("gram"))


def candidates(misspelt: DataFrame, vocab: DataFrame, top: int = 5) -> DataFrame:
    """(word, candidate, score, rank) for the distinct words of ``misspelt`` (word).

    A known word is its own candidate, as is one that shares no k-gram with any.
    Words meet the vocabulary over shared k-grams, so Jaccard follows from counts.
    """
    w = misspelt.select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    known = w.join(vocab.select("word"), "word", "left_semi")
    new = w.join(vocab.select("word"), "word", "left_anti")
    g = new.select("word", F.explode(T.kgrams(F.col("word"))).alias("gram"), F.size(T.kgrams(F.col("word"))).alias("n"))
    v = vocab.join(vocab.agg(F.max("cnt").alias("most")), how="cross").select(F.col("word").alias("candidate"), "cnt", "most", F.explode(T.kgrams(F.col("word"))).alias("gram"), F.size(T.kgrams(F.col("word"))).alias("m"))
    both = g.join(v, "gram").groupBy("word", "candidate", "n", "m", "cnt", "most").agg(F.count(F.lit(1)).alias("shared"))
    jac = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    score = 0.75 * jac + 0.20 * F.col("cnt") / F.col("most") + 0.05 / (1.0 + F.abs(F.length("candidate") - F.length("word")))
    t = both.select("word", "candidate", jac.alias("jac"), "cnt", score.alias("score"))
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.round("score", 12).desc(), F.round("jac", 12).desc(), F.desc("cnt"), F.desc("candidate")))
    t = t.withColumn("rank", rank).where(F.col("rank") <= top).select("word", "candidate", "score", "rank")
    alone = known.unionByName(new.join(t.select("word").distinct(), "word", "left_anti"))
    return t.unionByName(alone.select("word", F.col("word").alias("candidate"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank")))


def spell_check(queries: DataFrame, vocab: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, corrected): known words in lower case, others by their best candidate; punctuation and a leading capital stay."""
    t = queries.select(F.col(id_col).alias("query_id"), F.posexplode(F.filter(F.split(F.coalesce(text_col, F.lit("")), r"(?U)\s+"), lambda x: x != "")).alias("pos", "token"))
    prefix, core, suffix = T.query_parts(F.col("token"))
    t = t.select("query_id", "pos", "token", prefix.alias("prefix"), core.alias("core"), suffix.alias("suffix"))
    best = candidates(t.select(F.lower("core").alias("word")), vocab, 1).select(F.col("word").alias("__w"), "candidate")
    t = t.join(best, F.lower(F.col("core")) == F.col("__w"), "left")
    fixed = F.when(F.col("core") == "", F.col("token")).otherwise(F.concat("prefix", T.capitalize_like(F.coalesce("candidate", F.lower("core")), F.col("core")), "suffix"))
    t = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", fixed.alias("x")))).alias("xs"))
    out = t.select("query_id", F.array_join(F.col("xs.x"), " ").alias("corrected"))
    return queries.select(F.col(id_col).alias("query_id")).join(out, "query_id", "left").select("query_id", F.coalesce("corrected", F.lit("")).alias("corrected"))
