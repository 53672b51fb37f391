"""Field-wise inverted index as long tables.

postings(field, term, doc_id, tf), doc_lengths(field, doc_id, dl),
field_stats(field, avgdl, n_docs) and tiers = postings + tier. Long tables join and
aggregate on their keys and prune by field when written partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("characters", "genres", "description")
#: Least tf of the first and second tier of each field.
TIERS = {"characters": (3, 2), "description": (10, 5), "genres": (1, 0)}


def latest(docs: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row per identifier, the last by ``order``; rows with a null identifier go. Identifiers become strings."""
    last = W.partitionBy(F.col(id_col).cast("string")).orderBy(F.col(order).desc_nulls_last())
    ranked = docs.where(F.col(id_col).isNotNull()).withColumn("__rn", F.row_number().over(last))
    return ranked.where("__rn = 1").drop("__rn").withColumn(id_col, F.col(id_col).cast("string"))


def field_terms(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(doc_id, field, terms): ``fields`` gives an array of terms for each field; null arrays are empty."""
    none = F.array().cast("array<string>")
    each = [F.struct(F.lit(f).alias("field"), F.coalesce(c, none).alias("terms")) for f, c in fields.items()]
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(*each)))


def postings(terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(field, term, doc_id, tf). ``only`` (term) restricts to its terms before anything is counted."""
    t = terms.select("field", "doc_id", F.explode("terms").alias("term"))
    if only is not None:
        t = t.join(only.select("term").distinct(), "term", "left_semi")
    return t.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(terms: DataFrame) -> DataFrame:
    """(field, doc_id, dl), documents without terms included."""
    return terms.select("field", "doc_id", F.size("terms").cast("long").alias("dl"))


def lengths_of_postings(posts: DataFrame) -> DataFrame:
    """Lengths where no table of them exists: the sum of tf, so documents without terms are missing."""
    return posts.groupBy("field", "doc_id").agg(F.sum("tf").alias("dl"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """(field, avgdl, n_docs)."""
    return lengths.groupBy("field").agg((F.sum("dl") / F.count(F.lit(1))).alias("avgdl"), F.count(F.lit(1)).alias("n_docs"))


def field_sizes(lengths: DataFrame) -> DataFrame:
    """(field, clen): the number of terms in a field."""
    return lengths.groupBy("field").agg(F.sum("dl").alias("clen"))


#: Names that a field's average length may be stored under, tried in this order.
ALIASES = ("{field}", "{field}_document_length", "document_length")


def average_length(stats: DataFrame, field: str, aliases: tuple[str, ...] = ALIASES) -> DataFrame:
    """(avgdl): of the first of ``aliases`` that ``stats`` (field, avgdl) has; 0 if it has none or the value is null."""
    names = [a.format(field=field) for a in aliases]
    order = F.array_position(F.lit(names), F.col("field"))
    found = stats.where(F.col("field").isin(*names)).agg(F.min_by("avgdl", order).alias("avgdl"))
    return found.select(F.coalesce(F.col("avgdl").cast("double"), F.lit(0.0)).alias("avgdl"))


def tiers(posts: DataFrame, thresholds: dict[str, tuple[int, int]] = TIERS) -> DataFrame:
    first = F.coalesce(*[F.when(F.col("field") == f, F.lit(t[0])) for f, t in thresholds.items()])
    second = F.coalesce(*[F.when(F.col("field") == f, F.lit(t[1])) for f, t in thresholds.items()])
    return posts.withColumn("tier", F.when(F.col("tf") >= first, 1).when(F.col("tf") >= second, 2).otherwise(3))


def term_stats(posts: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """(..., term, df, cf)."""
    return posts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def lookup(posts: DataFrame, terms: list[str], field: str | None = None) -> DataFrame:
    """Postings of ``terms``; on a written table the filter reaches the scan."""
    found = posts.where(F.col("term").isin(*terms))
    return found.where(F.col("field") == field) if field else found


def add_documents(posts: DataFrame, new: DataFrame) -> DataFrame:
    """``posts`` with the postings of ``new`` in place of equal (field, term, doc_id); other terms of an older version stay."""
    return posts.join(new, ["field", "term", "doc_id"], "left_anti").unionByName(new)


def remove_documents(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """``posts`` without the documents of ``ids`` (doc_id); terms that lose their last posting vanish."""
    return posts.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(posts.columns)


def self_check(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """Differences between ``posts`` and what counting ``terms`` anew gives; no rows if the index is right."""
    fresh = postings(terms).select("field", "term", "doc_id", "tf")
    old = posts.select("field", "term", "doc_id", "tf")
    return old.exceptAll(fresh).withColumn("side", F.lit("index")).unionByName(fresh.exceptAll(old).withColumn("side", F.lit("corpus")))


def build(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> dict[str, DataFrame]:
    """All tables of an index, lazily."""
    return tables(field_terms(docs, id_col, fields))


def tables(terms: DataFrame) -> dict[str, DataFrame]:
    """The same from field terms, best a written table, as each of the four reads them."""
    posts, lengths = postings(terms), doc_lengths(terms)
    return {"postings": posts, "doc_lengths": lengths, "field_stats": field_stats(lengths), "tiers": tiers(posts)}
