"""Queries of product texts, requests, answers, checks and text representation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import answers, checks, hooks, metrics, represent
from corvane.plans import sql as S
from corvane.plans.lexical import table
from corvane.session import spread
from corvane.sources import files

REQUESTS = (
    (0, "text", "gray fabric sofa for a small living room, not leather"),
    (1, "image", None),
    (2, "image_text", "a red ring and a blue bolt, not plastic, NOT too heavy; not plastic"),
    (3, "text", "small widget"),
)


def _requests(spark) -> DataFrame:
    return spark.createDataFrame(list(REQUESTS), "query_id long, query_type string, query_text string")


def _catalog(spark, d) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("dimensions"))
    return t.withColumn("product_text", T.product_text(dict(t.dtypes)))


def _hits(spark, d, top: int = 20) -> DataFrame:
    """Products by shared words with the request, then by identifier.

    The words of the requests, a fixed few, go to the catalog; its words, many
    times its files' size, would else count as small enough to be sent to all.
    """
    from pyspark.sql import Window as W

    q = F.broadcast(_requests(spark).select("query_id", F.explode(F.array_distinct(T.words(F.col("query_text")))).alias("w")))
    p = _catalog(spark, d).select("product_id", F.explode(F.array_distinct(T.words(F.col("product_text")))).alias("w"))
    t = q.join(p, "w").groupBy("query_id", "product_id").agg(F.count(F.lit(1)).alias("score"))
    return t.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "product_id"))).where(F.col("rank") <= top)


def _few_hits(spark, d) -> DataFrame:
    """The hits, at most 20 of each of the few requests, to be sent to the catalog."""
    return F.broadcast(_hits(spark, d))


def product_text(spark, d):
    return _catalog(spark, d).select("product_id", "product_text")


def product_text_short(spark, d):
    t = _catalog(spark, d).drop("product_text")
    return t.select("product_id", T.product_text(dict(t.dtypes), dimensions=False, trim=False, fallback=None).alias("product_text"))


def catalog_checks(spark, d):
    return checks.catalog(_catalog(spark, d)).select("check", "passed")


def infer_need(spark, d):
    pos, neg = T.infer_need(F.col("query_text"))
    return _requests(spark).select("query_id", F.array_join(pos, "|").alias("positives"), F.array_join(neg, "|").alias("negatives"), T.has_negation(F.col("query_text")).alias("negated"))


def lexical_hits(spark, d):
    return _hits(spark, d)


def lexical_scores(spark, d):
    """The stand-in for a cross-encoder on the hits."""
    t = _few_hits(spark, d).join(_catalog(spark, d), "product_id").join(F.broadcast(_requests(spark)), "query_id")
    return t.select("query_id", "product_id", F.round(hooks.lexical_score(F.col("query_text"), F.col("product_text")), 6).alias("score"))


def fallback_answer(spark, d):
    t = answers.fallback(_requests(spark), _few_hits(spark, d), _catalog(spark, d))
    j = F.explode_outer("answer.product_judgements").alias("j")
    t = t.select("query_id", "answer.decision", "answer.interpreted_need.category", j)
    return t.select("query_id", "decision", "category", F.col("j.product_id").alias("product_id"), F.col("j.role").alias("role"), F.array_join("j.evidence", "|").alias("evidence"))


def answer_violations(spark, d):
    """Faults of the fallback answers after every second one was damaged."""
    t = answers.fallback(_requests(spark), _few_hits(spark, d), _catalog(spark, d))
    allowed = _hits(spark, d, 3).groupBy("query_id").agg(F.collect_set(F.col("product_id").cast("string")).alias("allowed"))
    t = t.join(allowed, "query_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    a = F.when(F.col("query_id") % 2 == 0, F.col("answer").withField("decision", F.lit("buy")).withField("customer_response", F.lit("low price"))).otherwise(F.col("answer"))
    v = answers.violations(a, F.col("query_id").cast("string"), F.col("allowed"))
    return t.select("query_id", F.explode(v).alias("violation"))


def answer_status(spark, d):
    return answers.answer(_requests(spark), _few_hits(spark, d), _catalog(spark, d)).select("query_id", "status", "answer.decision")


def answer_prompts(spark, d):
    return answers.prompts(_requests(spark), _few_hits(spark, d), _catalog(spark, d)).select("query_id", F.length("prompt").alias("n_chars"), F.col("prompt").contains("Products: [{").alias("has_products"))


def query_violations(spark, d):
    q = _requests(spark).select(F.col("query_id").cast("string").alias("query_id"), "query_text", F.lit(None).cast("string").alias("query_image_path"), F.when(F.col("query_id") == 3, "video").otherwise(F.col("query_type")).alias("query_type"), F.lit("test").alias("split"))
    return files.query_violations(q)


def qrels_violations(spark, d):
    """Annotations made of ``labels``: grades 3 are invalid, reasons may be empty, and each tenth pair is repeated."""
    t = table(spark, d, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic")) + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("string").alias("relevance"), F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 11 == 0, "auto: x").otherwise("read").alias("reason"))
    twice = t.select((F.col("doc_id") * 2).alias("row"), "*").unionByName(t.where("doc_id % 10 = 0").select((F.col("doc_id") * 2 + 1).alias("row"), "*"))
    twice = twice.select("row", (F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("product_id"), F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("relevance")).alias("relevance"), "reason")
    return answers.qrels_violations(twice, "row")


def skipgram_pairs(spark, d):
    return represent.pair_counts(table(spark, d, "benchmark").select(T.corpus_words(F.col("text")).alias("words")), 2)


def _corpus(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents")).select(T.corpus_words(F.col("text")).alias("words"))


def skipgram_pairs_documents(spark, d):
    """Pairs of all documents; ``skipgram_pairs`` has those of the benchmark's few texts."""
    return represent.pair_counts(_corpus(spark, d), 2)


def word2idx(spark, d):
    return represent.word_index(_corpus(spark, d))


def top_tokens(spark, d):
    return represent.top_tokens(represent.token_counts(_corpus(spark, d)), 20)


def stratified_split(spark, d):
    t = represent.stratified_split(table(spark, d, "labels"), "quality", "doc_id")
    return t.select("doc_id", "quality", "split")


def stratified_sample(spark, d):
    return represent.stratified_sample(table(spark, d, "labels"), "toxic", "doc_id", 0.1).select("doc_id", "toxic")


def top_titles(spark, d):
    return represent.top_classes(table(spark, d, "documents"), "source")


def of_top_titles(spark, d):
    docs = table(spark, d, "documents")
    t = represent.label_index(represent.of_classes(docs, represent.top_classes(docs, "source"), "source"), "source")
    return t.groupBy("source", "label_idx").agg(F.count(F.lit(1)).alias("n"))


def class_weights(spark, d):
    t = represent.class_weights(table(spark, d, "documents"), "lang")
    return t.groupBy("lang").agg(F.round(F.first("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def json_fields(spark, d):
    """Values of a JSON column by event type."""
    t = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return t.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def labelled_lines(spark, d):
    t = table(spark, d, "part").select("p_partkey", T.labelled_line(["p_name", "p_type"], ["title", "genre"]).alias("line"))
    return t.select("p_partkey", "line", T.shorten(F.col("line"), 12).alias("short"))


def representative_queries(spark, d):
    return metrics.representatives(_requests(spark))


def label_accuracy(spark, d):
    """How often quality says the same as the absence of toxicity."""
    t = metrics.accuracy(table(spark, d, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")
    return t.select(F.round("accuracy", 6).alias("accuracy"), "n")


def answer_acceptance(spark, d):
    """Conversation turns as stand-ins for answers of two models."""
    status = F.get(F.array(F.lit("direct"), F.lit("repair"), F.lit("fallback")), (F.col("turn") % 3).cast("int"))
    return metrics.acceptance(table(spark, d, "conversations").select(F.col("role").alias("model"), status.alias("status")))


def marked_tokens(spark, d):
    t = table(spark, d, "benchmark").select("item_id", T.marked_tokens(F.col("text")).alias("w"))
    return t.select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("tokens"))


def highlight(spark, d):
    return table(spark, d, "part").select("p_partkey", T.highlight(F.col("p_name"), "ring").alias("name"))


QUERIES = {
    f.__name__: f
    for f in (product_text, product_text_short, catalog_checks, infer_need, lexical_hits, lexical_scores, fallback_answer, answer_violations, answer_status, answer_prompts, query_violations, qrels_violations, skipgram_pairs, skipgram_pairs_documents, word2idx, top_tokens, stratified_split, stratified_sample, top_titles, of_top_titles, class_weights, json_fields, labelled_lines, representative_queries, label_accuracy, answer_acceptance, marked_tokens, highlight)
}

_TEXT = "concat_ws(chr(10), 'Title: ' || trim(p_name), 'Product type: ' || trim(p_type), 'Brand: ' || trim(p_brand), 'Dimensions: ' || p_size)"
_REQ = "req AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.quoted(k)}, {S.quoted(t) if t else 'NULL'})" for i, k, t in REQUESTS) + ") v(query_id, query_type, query_text))"
_CAT = f"cat AS (SELECT p_partkey AS product_id, p_name AS title, p_type AS product_type, {_TEXT} AS product_text FROM part)"
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"
_HITS = f"""WITH {_REQ}, {_CAT},
h0 AS (SELECT query_id, product_id, count(*) AS score FROM (SELECT query_id, unnest({_WORDS.format('query_text')}) AS w FROM req) JOIN (SELECT product_id, unnest({_WORDS.format('product_text')}) AS w FROM cat) USING (w) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM h0 QUALIFY rank <= 20)"""
# Fixed values, written apart from those of the query.
_CORPUS_STOP = """(SELECT unnest(string_split('i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
title titl author description descript genre genres genr place places goodreads goodread page pages book books edition editions isbn cover paperback hardcover kindle ebook', ' ')))""".replace("\n", " ").removeprefix("(SELECT unnest(").removesuffix("))")
_CORPUS = "list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains(" + _CORPUS_STOP + ", w))"
_CK = {"ids are not empty": "true", "titles are not empty": "true", "texts are not empty": "true", "ids are unique": "true", "more than one type": "true", "texts are longer than titles": "true"}

ORACLE_SQL = {
    "product_text": f"SELECT p_partkey AS product_id, {_TEXT} AS product_text FROM part",
    "product_text_short": "SELECT p_partkey AS product_id, concat_ws(chr(10), 'Title: ' || p_name, 'Product type: ' || p_type, 'Brand: ' || p_brand) AS product_text FROM part",
    "catalog_checks": " UNION ALL ".join(f"SELECT {S.quoted(k)} AS \"check\", {v} AS passed" for k, v in _CK.items()),
    "infer_need": f"""WITH {_REQ} SELECT query_id,
  array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(coalesce(query_text, ''), '\\bnot\\s+[^,.;]+', '', 'gi'), ',|\\band\\b'), lambda x: trim(x)), lambda x: x <> '')[1:6], '|') AS positives,
  array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(query_text, ''), '\\bnot\\s+([^,.;]+)', 1, 'i'), lambda x: 'not ' || trim(x)))), lambda x: x), '|') AS negatives,
  coalesce(contains(lower(query_text), ' not '), false) AS negated FROM req""",
    "lexical_hits": f"{_HITS} SELECT query_id, product_id, score, rank FROM hits",
    "lexical_scores": f"""{_HITS} SELECT query_id, product_id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS score FROM (SELECT query_id, product_id, {_WORDS.format('query_text')} AS a, {_WORDS.format('product_text')} AS b FROM hits JOIN cat USING (product_id) JOIN req USING (query_id))""",
    "fallback_answer": f"""{_HITS} SELECT query_id, CASE WHEN product_id IS NULL THEN 'no_good_match' ELSE 'recommend_substitute' END AS decision, coalesce(any_value(product_type) FILTER (rank = 1) OVER (PARTITION BY query_id), CASE WHEN query_type = 'image' THEN 'visual match' ELSE 'product' END) AS category,
  product_id::VARCHAR AS product_id, CASE WHEN product_id IS NOT NULL THEN 'substitute' END AS role, product_type AS evidence FROM req LEFT JOIN (SELECT * FROM hits JOIN cat USING (product_id) WHERE rank <= 5) USING (query_id)""",
    "answer_violations": f"""{_HITS}, n AS (SELECT query_id, count(product_id) AS n FROM req LEFT JOIN hits USING (query_id) GROUP BY 1)
SELECT query_id, unnest(list_filter([CASE WHEN n = 0 THEN 'product_judgements must be a non-empty list' END, CASE WHEN n > 3 THEN 'product_id outside the ranked products' END, CASE WHEN query_id % 2 = 0 THEN 'invalid decision' END, CASE WHEN query_id % 2 = 0 THEN 'customer_response is too short' END, CASE WHEN query_id % 2 = 0 THEN 'customer_response uses: price' END], lambda x: x IS NOT NULL)) AS violation FROM n""",
    "answer_status": f"{_HITS} SELECT query_id, 'fallback' AS status, CASE WHEN count(product_id) > 0 THEN 'recommend_substitute' ELSE 'no_good_match' END AS decision FROM req LEFT JOIN hits USING (query_id) GROUP BY 1",
    "query_violations": f"""WITH {_REQ} SELECT query_id::VARCHAR AS query_id, unnest(CASE WHEN query_id = 3 THEN ['unknown query_type'] WHEN query_type = 'text' THEN []::VARCHAR[] ELSE ['query_image_path is missing'] END) AS violation FROM req""",
    "qrels_violations": """WITH t AS (SELECT doc_id, quality * (2 - toxic) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS g, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'auto: x' ELSE 'read' END AS reason FROM labels),
v AS (SELECT doc_id * 2 AS row, list_filter(CASE WHEN doc_id % 13 = 0 THEN ['relevance must be 0, 1, or 2'] ELSE [CASE WHEN g NOT IN (0, 1, 2) THEN 'relevance is invalid' END, CASE WHEN reason = '' THEN 'reason is empty' END, CASE WHEN reason LIKE 'auto:%' THEN 'auto-generated labels are not allowed' END] END, lambda x: x IS NOT NULL) AS m FROM t
  UNION ALL SELECT doc_id * 2 + 1, ['duplicate pair'] FROM t WHERE doc_id % 10 = 0)
SELECT row, unnest(m) AS violation FROM v""",
    "skipgram_pairs": f"""WITH s AS (SELECT item_id, {_CORPUS} AS w FROM benchmark), p AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM s)
SELECT a.word AS center, b.word AS context, count(*) AS cnt FROM p a JOIN p b ON a.item_id = b.item_id AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY ALL""",
    "skipgram_pairs_documents": f"""WITH s AS (SELECT row_number() OVER () AS row, {_CORPUS} AS w FROM documents), p AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM s)
SELECT a.word AS center, b.word AS context, count(*) AS cnt FROM p a JOIN p b ON a.row = b.row AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY ALL""",
    "word2idx": f"SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT unnest(w) AS word FROM (SELECT {_CORPUS} AS w FROM documents) WHERE len(w) >= 2)",
    "top_tokens": f"SELECT word, count(*) AS cnt FROM (SELECT unnest({_CORPUS}) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "stratified_split": "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|0'), doc_id) <= greatest(least(round_even(count(*) OVER (PARTITION BY quality) * 0.2, 0)::BIGINT, count(*) OVER (PARTITION BY quality) - 1), 1) THEN 'val' ELSE 'train' END AS split FROM labels",
    "stratified_sample": "SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR || '|0'), doc_id) AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels) WHERE i <= least(greatest(round_even(n * 0.1, 0)::BIGINT, 2), n)",
    "top_titles": "SELECT source, count(*) AS cnt FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "of_top_titles": "SELECT source, row_number() OVER (ORDER BY source) - 1 AS label_idx, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)",
    "class_weights": "SELECT lang, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight, count(*) AS n FROM documents GROUP BY 1",
    "json_fields": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "representative_queries": f"WITH {_REQ} SELECT query_type AS kind, min(query_id) AS query_id FROM req GROUP BY 1 UNION ALL SELECT 'negation', min(query_id) FROM req WHERE contains(lower(query_text), ' not ')",
    "label_accuracy": "SELECT round(avg((quality = 1 - toxic)::INT), 6) AS accuracy, count(*) AS n FROM labels",
    "answer_acceptance": "SELECT role AS model, count(*) AS n, count(*) FILTER (turn % 3 = 0) AS direct, count(*) FILTER (turn % 3 = 1) AS repair, count(*) FILTER (turn % 3 = 2) AS fallback FROM conversations GROUP BY 1",
    "marked_tokens": "SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?|[^\\p{L}\\p{N}_\\s]') AS w FROM benchmark)",
    "highlight": "SELECT p_partkey, regexp_replace(p_name, '\\b(ring)\\b', '<mark>\\1</mark>', 'gi') AS name FROM part",
    "labelled_lines": "SELECT p_partkey, line, CASE WHEN length(line) > 12 THEN left(line, 12) || '...' ELSE line END AS short FROM (SELECT p_partkey, concat_ws(' ', 'title', p_name, 'genre', p_type) AS line FROM part)",
}
