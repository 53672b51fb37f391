import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import answers as A
from corvane.operators import checks, hooks
from corvane.plans import products
from corvane.sources import files
from corvane.streaming import incremental


def test_extract_json():
    assert A.extract_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert A.extract_json('say {"a": "x } \\" {", "b": {"c": 2}} end') == '{"a": "x } \\" {", "b": {"c": 2}}'
    assert A.extract_json("no object") is None and A.extract_json("{broken") is None and A.extract_json(None) is None


@pytest.fixture(scope="module")
def shop(spark):
    q = spark.createDataFrame([("q1", "text", "red sofa, not leather"), ("q2", "image", None), ("q3", "text", "nothing")], "query_id string, query_type string, query_text string")
    hits = spark.createDataFrame([("q1", f"p{i}", i) for i in range(1, 8)] + [("q2", "p2", 1)], "query_id string, product_id string, rank int")
    p = spark.createDataFrame([(f"p{i}", f"Title {i}", "sofa" if i % 2 else " ", "red" if i < 4 else None) for i in range(1, 8)], "product_id string, title string, product_type string, color string")
    return q, hits, p


def test_fallback(shop):
    got = {r.query_id: r.answer for r in A.fallback(*shop).collect()}
    assert [j.product_id for j in got["q1"].product_judgements] == ["p1", "p2", "p3", "p4", "p5"]
    assert got["q1"].product_judgements[0].evidence == ["sofa", "red"] and got["q1"].product_judgements[3].evidence == ["Title 4"]
    assert got["q1"].interpreted_need.negative_constraints == ["not leather"] and got["q1"].interpreted_need.category == "sofa"
    assert got["q2"].interpreted_need.category == "visual match" and got["q2"].product_judgements[0].reason == A.IMAGE_REASON
    assert got["q3"].decision == "no_good_match" and got["q3"].product_judgements == []


class Scripted:
    """Answers badly at first, then well for q1 only."""

    def generate(self, prompts):
        out = []
        for p in prompts:
            good = {"query_id": "q1", "interpreted_need": {"category": "sofa", "positive_preferences": [], "negative_constraints": [], "visual_preferences": [], "uncertain_fields": []}, "product_judgements": [{"product_id": "p1", "role": "exact", "evidence": [], "constraint_violations": [], "reason": "fits"}], "decision": "recommend_exact", "customer_response": "one two three four five six seven eight"}
            out.append("sure: " + json.dumps(good) if "Query ID: q1" in p and "invalid" in p else "I decorate with ratings")
        return out


def test_answer_loop(shop):
    got = {r.query_id: r for r in A.answer(*shop, generator=Scripted()).collect()}
    assert (got["q1"].status, got["q1"].n_attempts, got["q1"].answer.decision) == ("repair", 2, "recommend_exact")
    assert (got["q2"].status, got["q2"].n_attempts) == ("fallback", 3)
    plain = {r.status for r in A.answer(*shop).collect()}
    assert plain == {"fallback"}


def test_violations_find_each_fault(spark, shop):
    t = A.fallback(*shop).where("query_id = 'q1'").withColumn("allowed", F.array(*[F.lit(f"p{i}") for i in range(1, 6)]))
    a = F.col("answer")
    cases = [(a, 0), (F.lit(None).cast(A.ANSWER), 1), (a.withField("decision", F.lit("x")), 1), (a.withField("customer_response", F.lit("we like decorating it all in the same way")), 1), (a.withField("product_judgements", F.array().cast(f"array<{A.JUDGEMENT}>")), 1)]
    for col, n in cases:
        found = t.select(A.violations(col, F.col("query_id"), F.col("allowed")).alias("v")).first().v
        assert (len(found) >= 1) == bool(n), found


def test_sft_dataset(shop):
    q, hits, p = shop
    fall = A.fallback(q, hits, p)
    allowed = hits.groupBy("query_id").agg(F.collect_set("product_id").alias("allowed"))
    t = A.sft_dataset(A.prompts(q, hits, p), fall.where("query_id = 'q1'"), fall, allowed)
    assert {r.query_id: r.given for r in t.collect()} == {"q1": True, "q2": False, "q3": False}


def test_judgment_pool(spark):
    t = lambda ids: spark.createDataFrame([(q, i, r) for q in ("t", "i") for r, i in enumerate(ids, 1)], "query_id string, doc_id string, rank int")
    q = spark.createDataFrame([("t", "text"), ("i", "image")], "query_id string, query_type string")
    pool = A.judgment_pool([(t("abc"), True), (t("cde"), False)], t("fghijklm"), q, per_run=2, size=6)
    by = {}
    for r in pool.orderBy("query_id", "pos").collect():
        by.setdefault(r.query_id, []).append(r.doc_id)
    assert by == {"t": list("abcdfg"), "i": list("abfghi")}
    assert A.small_pools(pool, 7).count() == 2


def test_qrels(spark):
    rows = [(1, "q", "a", "2", "fine"), (2, "q", "a", "1", "again"), (3, "q", "b", "1.5", "x"), (4, "q", "c", "3", ""), (5, "q", "d", "0", "AUTO: x"), (6, "q", "e", None, "x"), (7, "q", "f", " 1.0 ", "ok")]
    t = spark.createDataFrame(rows, "row int, query_id string, product_id string, relevance string, reason string")
    got = sorted((r.row, r.violation) for r in A.qrels_violations(t, "row").collect())
    assert [x[0] for x in got] == [2, 3, 4, 4, 5, 6]
    with pytest.raises(ValueError):
        A.finalize_qrels(t, "row")
    assert [(r.product_id, r.relevance) for r in A.finalize_qrels(t.where("row in (1, 7)"), "row").orderBy("row").collect()] == [("a", 2), ("f", 1)]


def test_checks(spark):
    t = spark.createDataFrame([("q", "a", 1, 0.1, None, "image"), ("q", "a", 3, 0.2, 0.5, "image")], "query_id string, id string, rank int, dense_score double, sparse_score double, query_type string")
    known = spark.createDataFrame([("b",)], "id string")
    assert [r.passed for r in checks.results(t, known).collect()] == [False] * 4
    assert checks.alignment(t, known, "id").count() == 2
    v = spark.createDataFrame([([0.6, 0.8],), ([1.0, 1.0],)], "embedding array<double>")
    assert [r.passed for r in checks.dense_vectors(v).collect()] == [False, True, True]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "red sofa"), (2, None)], "id int, t string")
    rows = hooks.encode(df, F.col("t"), hooks.HashEncoder(16)).orderBy("id").collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9 and rows[1].error is None

    class Broken:
        def encode(self, texts):
            raise RuntimeError("no model")

    bad = hooks.encode(df, F.col("t"), Broken()).collect()
    assert all(r.embedding is None and r.error == "no model" for r in bad)
    assert hooks.encode_missing(df, spark.createDataFrame([(1,)], "id int"), "id", F.col("t"), hooks.HashEncoder(4)).count() == 1
    x = spark.createDataFrame([([[0.0, 2.0], [-1.0, 5.0]], [1, 0])], "l array<array<double>>, m array<int>")
    assert x.select(hooks.max_log_pool(F.col("l"), F.col("m"))).first()[0] == pytest.approx([0.0, 1.0986122886681098])


def test_books_csv(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("﻿Title,Authors,summary,genre,description\n\"A, B\",X,\"line\none\",\"['m', 'n']\",\nC,,s2,a|b,d2\n", encoding="utf-8")
    rows = files.read_books_csv(spark, str(p)).orderBy("id").collect()
    assert [(r.id, r.title, r.author, r.description, r.genres) for r in rows] == [("0", "A, B", "X", "line\none", ["m", "n"]), ("1", "C", "", "d2", ["a", "b"])]
    files.prepare(spark, str(p), str(tmp_path / "raw"), str(tmp_path / "pre"))
    assert files.read_jsonl(spark, str(tmp_path / "raw")).count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "pre")).count() == 2


@pytest.mark.parametrize("payload", [[{"id": "1", "title": "T", "description": ["a", " b"]}, {"id": "2", "title": "", "description": "x"}], {"items": [{"id": "1", "title": "T", "description": "a b"}]}, {"k": {"id": "1", "title": "T", "description": "a b"}}])
def test_records(spark, tmp_path, payload):
    p = tmp_path / "r.json"
    p.write_text(json.dumps(payload))
    assert [(r.id, r.title, r.description) for r in files.read_records(spark, str(p)).collect()] == [("1", "T", "a b")]


def test_other_files(spark, tmp_path):
    q = spark.createDataFrame([("1", "red", None, "text", "test")], files.QUERY_SCHEMA)
    files.write_jsonl(q, str(tmp_path / "q"))
    assert files.read_queries(spark, str(tmp_path / "q")).count() == 1
    files.write_jsonl(q.withColumn("query_type", F.lit("image")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        files.read_queries(spark, str(tmp_path / "bad"))
    pool = spark.createDataFrame([("q", "p", "", "two\nlines")], "query_id string, product_id string, relevance string, reason string")
    files.write_pool(pool, str(tmp_path / "pool"))
    assert files.read_pool(spark, str(tmp_path / "pool")).first().relevance == ""
    files.write_manifest(spark, {"dim": 8, "model": "x"}, str(tmp_path / "m"))
    m = files.read_jsonl(spark, str(tmp_path / "m")).first()
    assert m.dim == 8 and m.created_at
    s = spark.createDataFrame([("p", [3, 5], [1.0, 2.0], None), ("f", [], [], "failed")], files.SPARSE_SCHEMA)
    files.write_jsonl(s, str(tmp_path / "s"))
    back = files.read_sparse(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in files.sparse_long(back).collect()) == [("p", 3, 1.0), ("p", 5, 2.0)]
    assert checks.sparse_stats(back, error="error").first().failures == 1
    spark.range(2).withColumn("title", F.lit("x")).write.parquet(str(tmp_path / "cat"))
    with pytest.raises(ValueError):
        files.read_catalog(spark, str(tmp_path / "cat"))
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"1")
    t = spark.createDataFrame([("x/y/a.jpg",), ("b.png",)], "image_path string")
    got = {r.image_path: r.resolved for r in files.resolve_images(t, files.read_images(spark, str(tmp_path / "img")), "image_path").collect()}
    assert got["x/y/a.jpg"].endswith("img/a.jpg") and got["b.png"] is None
    assert "| 0 | x |" in files.markdown(spark.range(1).withColumn("t", F.lit("x")), "T")


def test_stream_keeps_postings_up_to_date(spark, tmp_path):
    from corvane.functions import text as T
    from corvane.operators import index

    src, schema = tmp_path / "in", "id string, text string, gone boolean"
    store = incremental.PostingsStore(spark, str(tmp_path / "posts"))
    fields = lambda: {"description": T.terms(F.col("text"))}

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = incremental.maintain(spark.readStream.schema(schema).parquet(str(src)), store, fields, "id", str(tmp_path / "cp"), removed="gone")
        q.awaitTermination(120)
        q.stop()

    feed([("1", "red ring", False), ("2", "blue bolt", False)])
    feed([("2", None, True), ("3", "red bolt", None)])
    want = index.postings(index.field_terms(spark.createDataFrame([("1", "red ring"), ("3", "red bolt")], "id string, text string"), "id", fields()))
    got = store.read()
    assert got.exceptAll(want.select(got.columns)).count() == 0 and want.select(got.columns).exceptAll(got).count() == 0


def test_skipgram_pairs_of_documents(spark, tmp_path):
    texts = ["alpha beta gamma alpha", "beta gamma", None, "", "delta", "hot " * 500, "alpha beta gamma alpha"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for w in ((t or "").split() for t in texts):
        want.update((a, b) for i, a in enumerate(w) for j, b in enumerate(w) if i != j and abs(i - j) <= 2)
    got = products.QUERIES["skipgram_pairs_documents"](spark, str(tmp_path)).collect()
    assert {(r.center, r.context): r.cnt for r in got} == want and len(got) == len(want)


def _sent(t):
    """What a plan sends to all tasks, as text."""
    lines = re.split(r"\n(?=[ :]*[:+]- )", t._jdf.queryExecution().executedPlan().toString())  # texts in a plan may have line ends
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            n = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))
            yield "\n".join(lines[i:n])


@pytest.mark.parametrize("name", ["lexical_hits", "lexical_scores", "fallback_answer", "answer_violations", "answer_status", "answer_prompts"])
def test_catalog_is_not_sent_to_all_tasks(spark, sf_dir, name):
    sent = list(_sent(products.QUERIES[name](spark, sf_dir)))
    assert sent and all("FileScan" not in x or "rank#" in x for x in sent), sent


def test_answers_join_any_hits_without_sending_the_catalog(spark, shop, tmp_path):
    q, hits, p = shop
    for k, t in {"h": hits, "p": p}.items():
        t.write.parquet(f"{tmp_path}/{k}")
    hits, p = (spark.read.parquet(f"{tmp_path}/{k}") for k in "hp")
    for make in (A.fallback, A.prompts):
        t = make(q, hits, p)
        assert "SortMergeJoin [product_id" in t._jdf.queryExecution().executedPlan().toString()
        assert t.count() == 3
