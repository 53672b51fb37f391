"""Ranking functions over postings: vector space, Okapi BM25 and unigram language models.

Inputs are postings(field, term, doc_id, tf), query terms (query_id, term, qtf) and,
where needed, doc_lengths and field_stats. Scores come per (query_id, field, doc_id).
Only matched postings are joined; what unmatched terms add is worked out per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = 1e-12
VECTOR_LETTERS = {"n", "l", "b", "a"}


def query_terms(queries: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(query_id, term, qtf)."""
    t = queries.select(F.col(id_col).alias("query_id"), F.explode(terms).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def parse_method(method: str) -> tuple[str, str]:
    """'ddd.qqq' (or with '-', or six letters) → document and query letters, padded with n; empty is lnc.ltc.

    Unlike a lenient parser this rejects names that aren't of that form.
    """
    m = (method or "lnc.ltc").replace("-", ".")
    parts = m.split(".") if "." in m else [m[:3], m[3:6]]
    if len(parts) != 2 or any(len(p) > 3 for p in parts):
        raise ValueError(f"no vector method: {method!r}")
    return tuple((p + "nnn")[:3] for p in parts)


def tf_weight(tf: Column, letter: str) -> Column:
    """n: tf, l: 1 + ln tf, b: 1, a: 0.5 + 0.5 tf; any other letter: tf; 0 for tf <= 0."""
    x = tf.cast("double")
    w = {"l": 1 + F.log(x), "b": F.lit(1.0), "a": 0.5 + 0.5 * x}.get(letter.lower(), x)
    return F.when(x > 0, w).otherwise(F.lit(0.0))


def _stats(posts: DataFrame, n_docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """postings with df and N; ``n_docs`` has (field, n_docs)."""
    df = posts.groupBy("field", *extra, "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n_docs.select("field", F.greatest("n_docs", F.lit(1)).alias("n")), "field")


def vector_space(posts: DataFrame, queries: DataFrame, stats: DataFrame, method: str = "ltn.lnn", extra: tuple[str, ...] = ()) -> DataFrame:
    """Sum over distinct query terms of document weight times query weight; zero scores go.

    A cosine letter normalises over the query's terms only. ``extra`` are further
    keys of the postings (a tier) that df counts within.
    """
    d, q = parse_method(method)
    keys = ["field", *extra]
    df = _stats(posts, stats, extra)
    # the query's weights take all its terms, those in no document with df 0
    places = posts.select(*keys).distinct().join(stats.select("field", F.greatest("n_docs", F.lit(1)).alias("n")), "field")
    w = queries.join(places, how="cross").join(df.drop("n"), [*keys, "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = w.withColumn("qw", tf_weight(F.col("qtf"), q[0]) * (idf(F.col("df"), F.col("n")) if q[1] == "t" else F.lit(1.0)))
    if q[2] == "c":
        norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(W.partitionBy("query_id", *keys)))
        w = w.withColumn("qw", F.when(norm > 0, F.col("qw") / norm).otherwise(F.col("qw")))
    m = posts.join(w.where("df > 0").select(*keys, "query_id", "term", "qw", "df", "n"), [*keys, "term"])
    m = m.withColumn("dw", tf_weight(F.col("tf"), d[0]) * (idf(F.col("df"), F.col("n")) if d[1] == "t" else F.lit(1.0)))
    norm = F.sqrt(F.sum(F.col("dw") * F.col("dw")))
    dot = F.sum(F.col("dw") * F.col("qw"))
    score = F.when(norm > 0, dot / norm).otherwise(dot) if d[2] == "c" else dot
    return m.groupBy("query_id", *keys, "doc_id").agg(score.alias("score")).where("score <> 0")


def bm25(posts: DataFrame, queries: DataFrame, lengths: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75, extra: tuple[str, ...] = ()) -> DataFrame:
    """Okapi BM25; a query term counts as often as it stands in the query. A missing length is 0; no average length: the document's own."""
    keys = ["field", *extra]
    df = _stats(posts, stats, extra).join(stats.select("field", "avgdl"), "field")
    m = posts.join(queries, "term").join(df, [*keys, "term"]).join(lengths, ["field", "doc_id"], "left")
    dl = F.coalesce("dl", F.lit(0)).cast("double")
    avg = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.greatest(dl, F.lit(1.0)))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = F.col("qtf") * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))
    return m.groupBy("query_id", *keys, "doc_id").agg(F.sum(part).alias("score"))


def _likelihood(posts: DataFrame, queries: DataFrame, lengths: DataFrame, smoothing: str, alpha: float, lam: float, clen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(query_id, field, dl, base): what a document of that length has without a match, and (query_id, field, doc_id, dl, more): what matches add."""
    kind = {"naive": "naive", "none": "naive", "bayes": "dirichlet", "dirichlet": "dirichlet", "bayesian": "dirichlet", "mixture": "jm", "jm": "jm", "jelinek-mercer": "jm"}.get((smoothing or "mixture").lower())
    if kind is None:
        raise ValueError(f"unknown smoothing method: {smoothing}")
    cf = posts.groupBy("field", "term").agg(F.sum("tf").alias("cf"))
    if clen is None:
        clen = cf.groupBy("field").agg(F.sum("cf").alias("clen"))
    n = lengths.groupBy("field").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    total = n.join(clen.select("field", F.col("clen").cast("double")), "field", "left").withColumn("clen", F.when(F.coalesce("clen", F.lit(0.0)) > 0, F.col("clen")).otherwise(F.lit(1.0)))
    q = queries.join(total, how="cross").join(cf, ["field", "term"], "left").withColumn("pc", F.coalesce("cf", F.lit(0)) / F.col("clen"))
    mu = F.lit(max(float(alpha), 0.0)) if alpha > 1 else max(float(alpha), 0.0) * F.greatest(F.col("clen") / F.col("n"), F.lit(1.0))
    lam = min(max(float(lam), 0.0), 1.0)

    def log_p(tf: Column, dl: Column) -> Column:
        p = {"naive": tf / dl, "dirichlet": (tf + mu * F.col("pc")) / (dl + mu), "jm": (1 - lam) * (tf / dl) + lam * F.col("pc")}[kind]
        return F.log(F.greatest(p, F.lit(FLOOR)))

    dl = F.greatest(F.col("dl"), F.lit(1)).cast("double")
    sizes = lengths.select("field", "dl").distinct()
    base = sizes.join(q, "field").groupBy("query_id", "field", "dl").agg(F.sum(F.col("qtf") * log_p(F.lit(0.0), dl)).alias("base"))
    m = posts.join(q, ["field", "term"]).join(lengths, ["field", "doc_id"])
    more = m.groupBy("query_id", "field", "doc_id", "dl").agg(F.sum(F.col("qtf") * (log_p(F.col("tf").cast("double"), dl) - log_p(F.lit(0.0), dl))).alias("more"))
    return base, more


def language_model(posts: DataFrame, queries: DataFrame, lengths: DataFrame, smoothing: str = "mixture", alpha: float = 0.5, lam: float = 0.5, clen: DataFrame | None = None) -> DataFrame:
    """Log likelihood of each query in every document of ``lengths``.

    A document's score is the sum over all query terms of what tf 0 would give,
    which depends on the length alone, plus corrections for matched postings. The
    first part is worked out per distinct length, so no document meets a term it
    doesn't hold. Probabilities have a floor of 1e-12, terms count as often as in
    the query. ``clen`` (field, clen) is the number of terms in a field, to be
    given if ``posts`` has the queries' terms only. There is a row for each query
    and document: to keep the k best, take ``language_top``.
    """
    base, more = _likelihood(posts, queries, lengths, smoothing, alpha, lam, clen)
    every = lengths.join(base, ["field", "dl"])
    return every.join(more.drop("dl"), ["query_id", "field", "doc_id"], "left").select("query_id", "field", "doc_id", (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("score"))


def language_top(posts: DataFrame, queries: DataFrame, lengths: DataFrame, k: int, smoothing: str = "mixture", alpha: float = 0.5, lam: float = 0.5, weights: dict[str, float] | None = None, clen: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best by the weighted sum of ``language_model`` over fields, without a row for each query and document.

    A match never lowers a score. So of the documents that match nowhere only those
    can be among the k best that are among them by their base already, and a base
    depends on a document's lengths alone. Documents are grouped by these, of each
    group the k smallest identifiers are kept, and a query meets its k best groups;
    to these come all documents that match. Weights must not be negative, nor
    missing: fields without one are not read. (doc_id, field) is unique in ``lengths``.
    """
    if k < 0 or (weights and min(weights.values()) < 0):
        raise ValueError("k and the weights must not be negative")
    if weights is not None:
        used = [f for f, w in weights.items() if w]
        posts, lengths = (t.where(F.col("field").isin(*used) if used else F.lit(False)) for t in (posts, lengths))
    base, more = _likelihood(posts, queries, lengths, smoothing, alpha, lam, clen)
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()], F.lit(0.0)) if weights else F.lit(1.0)
    shape = lengths.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("field", "dl"))).alias("shape"))  # at most a few fields
    name = F.col("doc_id").cast("string")
    first = shape.withColumn("__i", F.row_number().over(W.partitionBy("shape").orderBy(name))).where(F.col("__i") <= k)  # cut on the map side too
    parts = first.where("__i = 1").select("shape", name.alias("__least"), F.inline("shape"))
    by_shape = parts.join(base, ["field", "dl"]).groupBy("query_id", "shape", "__least").agg(F.sum(weight * F.col("base")).alias("__base"))
    best = W.partitionBy("query_id").orderBy(F.round("__base", digits).desc(), "__least")
    near = by_shape.withColumn("__g", F.row_number().over(best)).where(F.col("__g") <= k).drop("__g", "__least")
    bare = near.join(first, "shape").select("query_id", "doc_id", F.col("__base").alias("part"))
    bare = bare.withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy(F.round("part", digits).desc(), name))).where(F.col("__r") <= k).drop("__r")
    # matched documents: the base of all their fields, and what each match adds
    found = more.select("query_id", "doc_id").distinct().unionByName(bare.select("query_id", "doc_id")).distinct()
    whole = found.join(lengths, "doc_id").join(base, ["query_id", "field", "dl"])
    whole = whole.join(more.drop("dl"), ["query_id", "field", "doc_id"], "left")
    scores = whole.groupBy("query_id", "doc_id").agg(F.sum(weight * (F.col("base") + F.coalesce("more", F.lit(0.0)))).alias("score"))
    return top_k(scores, k, digits)


def top_k(scores: DataFrame, k: int | None, digits: int | None = 9) -> DataFrame:
    """(query_id, doc_id, score, rank): by descending score, then by identifier as a string; None or -1 keeps all.

    Scores are compared to ``digits`` decimals, so the order in which sums were
    formed can't decide a tie. Other negative k are rejected.
    """
    if k is not None and k < -1:
        raise ValueError("k must be -1 or at least 0")
    by = F.round("score", digits) if digits else F.col("score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(by.desc(), F.col("doc_id").cast("string")))
    t = scores.withColumn("rank", rank)
    return t if k in (None, -1) else t.where(F.col("rank") <= k)
