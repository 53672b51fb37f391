import math

import pytest

from corvane.operators import metrics as M


def frame(spark, runs):
    return spark.createDataFrame([(q, r, d) for q, docs in runs.items() for r, d in enumerate(docs, 1)], "query_id int, rank int, doc_id string")


def test_binary_golden_values(spark):
    runs = frame(spark, {1: ["1", "3", "4"], 2: ["2", "1"]})
    qrels = spark.createDataFrame([(1, "1"), (1, "4"), (2, "2")], "query_id int, doc_id string")
    r = M.evaluation(M.binary_per_query(runs, qrels)).first()
    assert [round(x, 6) for x in (r.precision, r.recall, r.f1, r.map, r.mrr)] == [0.583333, 1.0, 0.736842, 0.916667, 1.0]


def test_binary_edges(spark):
    """No results, no judgments, and a repeated result: it uses up a rank, counts once in precision and twice in gain."""
    runs = frame(spark, {1: ["a", "a", "b"], 3: ["x"]})
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, doc_id string")
    q = spark.createDataFrame([(4,)], "query_id int")
    per = {r.query_id: r for r in M.binary_per_query(runs, qrels, q).collect()}
    assert set(per) == {1, 2, 3, 4}
    assert per[1].precision == 1.0 and per[1].recall == 1.0
    assert per[1].ap == pytest.approx((1 + 2 / 3) / 2)
    assert per[1].dcg == pytest.approx(1 + 1 / math.log2(3) + 0.5)
    assert (per[2].precision, per[2].recall, per[2].ap, per[2].ndcg) == (0, 0, 0, 0)
    assert (per[3].precision, per[3].rr, per[4].dcg) == (0, 0, 0)


def test_graded_golden_values(spark):
    runs = spark.createDataFrame([("r", "q", i, d) for i, d in enumerate("abc", 1)], "run_name string, query_id string, rank int, doc_id string")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "c", 1), ("q", "x", 1)], "query_id string, doc_id string, relevance int")
    r = M.graded_per_query(runs, qrels).first()
    assert r.map == pytest.approx(5 / 9) and r.recall_at_10 == pytest.approx(2 / 3) and r.precision_at_5 == pytest.approx(2 / 5)
    assert r.ndcg_at_5 == pytest.approx(0.8472668888)
    assert r.judged_coverage == pytest.approx(2 / 3)
    none = M.graded_per_query(runs, qrels.limit(0)).first()
    assert none.map == 0 and none.ndcg_at_10 == 0


def test_report_names_all_types(spark):
    runs = spark.createDataFrame([("r", q, 1, "a") for q in "xy"], "run_name string, query_id string, rank int, doc_id string")
    qrels = spark.createDataFrame([("x", "a", 1)], "query_id string, doc_id string, relevance int")
    q = spark.createDataFrame([("x", "text"), ("y", None)], "query_id string, query_type string")
    rows = {(r.query_type, r.num_queries) for r in M.report(M.graded_per_query(runs, qrels), q).collect()}
    assert rows == {("text", 1), (None, 1), ("all", 2)}


def test_rank_by_drops_missing_scores(spark):
    t = spark.createDataFrame([("q", "a", 1, None), ("q", "b", 2, 0.5), ("q", "c", 3, 0.5)], "query_id string, doc_id string, rank int, s double")
    assert [(r.rank, r.doc_id) for r in M.rank_by(t, "s", "x").orderBy("rank").collect()] == [(1, "b"), (2, "c")]


def test_lengths_must_agree(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "query_id int, doc_id string")
    M.same_length(a, a)
    with pytest.raises(ValueError, match="same length"):
        M.same_length(a, a.where("query_id = 1"))
    M.same_length(a.limit(0), a.limit(0))


def test_error_lists(spark):
    runs = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, doc_id string")
    cases = spark.createDataFrame([("helps", 1), ("hurts", 1)], "case string, query_id int")
    qrels = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "query_id int, doc_id string, relevance int")
    got = M.error_lists(cases, runs([(1, 1, "b"), (1, 2, "a"), (2, 1, "a")]), runs([(1, 1, "a")]), qrels, 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(c, 1, s, 1, d, r) for c in ("helps", "hurts") for s, d, r in (("before", "b", None), ("after", "a", 2))], key=str)
