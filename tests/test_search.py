import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import index, near_duplicates, ranking, search, snippets, spelling
from corvane.session import freed
from corvane.sources import files

BOOKS = [
    ("1", "A young wizard enters a magic school and fights a dark lord", ["fantasy", "magic"], ["Arlo"]),
    ("2", "A crew travels through space to an alien planet", ["science fiction"], ["Mira"]),
    ("3", "Two neighbours fall in love over one long summer", ["romance"], ["Ana", "Leo"]),
    ("4", "Dark magic returns to the school of young wizards", ["fantasy"], ["Arlo", "Vane"]),
]
FIELDS = {"description": lambda: T.terms(F.col("description")), "genres": lambda: T.terms(F.array_join("genres", " ")), "characters": lambda: T.terms(F.array_join("characters", " "))}


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, "id string, description string, genres array<string>, characters array<string>")


@pytest.fixture(scope="module")
def engine(books):
    return search.SearchEngine(index.build(books, "id", {k: f() for k, f in FIELDS.items()}), books)


@pytest.mark.parametrize("options", [{"method": "ltn.lnn"}, {"method": "ltc.lnc"}, {"method": "OkapiBM25"}, {"method": "unigram"}, {"smoothing": "mixture"}, {"smoothing": "naive"}, {"smoothing": "bayes"}, {"method": "ltn.lnn", "safe": False}])
def test_magic_school(spark, engine, options):
    q = spark.createDataFrame([(7, "magic dark school")], "query_id int, query string")
    got = engine.search(q, 3, weights={"characters": 0.2, "genres": 0.2, "description": 0.6}, **options).orderBy("rank").collect()
    assert got and got[0].doc_id in ("1", "4")
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_unknown_names_are_rejected(spark, engine):
    q = spark.createDataFrame([(1, "magic")], "query_id int, query string")
    with pytest.raises(ValueError):
        engine.search(q, 3, smoothing="witten")
    with pytest.raises(ValueError):
        engine.search(q, -2)
    with pytest.raises(ValueError):
        ranking.parse_method("okapi-bm25")


def test_methods_are_padded():
    assert ranking.parse_method("") == ("lnc", "ltc") and ranking.parse_method("lt-n") == ("ltn", "nnn") and ranking.parse_method("ltclnc") == ("ltc", "lnc")


def docs_of(books):
    return {i: snippets.query_terms(d) for i, d, *_ in BOOKS}


def test_bm25_counts_repeated_query_terms(spark, books):
    t = index.field_terms(books, "id", {"description": T.terms(F.col("description"))})
    q = ranking.query_terms(spark.createDataFrame([(1, "magic magic dark")], "id int, q string"), "id", T.terms(F.col("q")))
    lengths = index.doc_lengths(t)
    got = {r.doc_id: r.score for r in ranking.bm25(index.postings(t), q, lengths, index.field_stats(lengths)).collect()}
    docs = docs_of(books)
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for d, terms in docs.items():
        tf = Counter(terms)
        for w in ("magic", "magic", "dark"):
            df = sum(w in x for x in docs.values())
            if tf[w]:
                want[d] = want.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(terms) / avg))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("kind", ["naive", "dirichlet", "jm"])
@pytest.mark.parametrize("alpha", [0.5, 3.0])
def test_language_models_against_the_dense_form(spark, books, kind, alpha):
    t = index.field_terms(books, "id", {"description": T.terms(F.col("description"))})
    q = ranking.query_terms(spark.createDataFrame([(1, "magic magic unseen dark")], "id int, q string"), "id", T.terms(F.col("q")))
    got = {r.doc_id: r.score for r in ranking.language_model(index.postings(t), q, index.doc_lengths(t), kind, alpha, 0.3).collect()}
    docs = docs_of(books)
    clen = sum(map(len, docs.values()))
    cf = Counter(w for x in docs.values() for w in x)
    mu = alpha if alpha > 1 else alpha * max(clen / len(docs), 1)
    for d, terms in docs.items():
        s = 0.0
        for w in ("magic", "magic", "unseen", "dark"):
            tf, dl, pc = terms.count(w), len(terms), cf[w] / clen
            p = {"naive": tf / dl, "dirichlet": (tf + mu * pc) / (dl + mu), "jm": 0.7 * tf / dl + 0.3 * pc}[kind]
            s += math.log(max(p, 1e-12))
        assert got[d] == pytest.approx(s)


def test_add_and_remove(spark, books):
    fields = {k: f() for k, f in FIELDS.items()}
    posts = index.postings(index.field_terms(books, "id", fields))
    new = spark.createDataFrame([("100", "good", ["mystery", "crime"], ["sandman", "robin"])], books.schema)
    more = index.postings(index.field_terms(new, "id", fields))
    added = index.add_documents(posts, more)
    assert added.exceptAll(posts).count() == more.count() == 5
    gone = index.remove_documents(added, spark.createDataFrame([("100",)], "doc_id string"))
    assert gone.exceptAll(posts).count() == 0 and posts.exceptAll(gone).count() == 0
    terms = index.field_terms(books, "id", fields)
    assert index.self_check(posts, terms).count() == 0
    assert index.self_check(added, terms).count() == 5


def test_latest_row_wins(spark):
    t = spark.createDataFrame([(1, 0, "old"), (1, 2, "new"), (None, 3, "x"), (2, 0, "only")], "id int, n int, v string")
    assert sorted((r.id, r.v) for r in index.latest(t, "id", "n").collect()) == [("1", "new"), ("2", "only")]


def test_index_files(spark, books, tmp_path):
    tables = index.build(books, "id", {k: f() for k, f in FIELDS.items()})
    root = str(tmp_path / "index")
    assert not files.index_exists(spark, root)
    files.write_index(tables, root)
    assert files.index_exists(spark, root)
    back = files.read_index(spark, root)
    for n, t in tables.items():
        assert t.select(sorted(t.columns)).exceptAll(back[n].select(sorted(t.columns))).count() == 0
    with pytest.raises(ValueError):
        files.index_path(root, "other")


def test_tiers_and_early_stop(spark):
    rows = [("description", "w", str(i), 12 if i < 3 else 6 if i < 6 else 1) for i in range(10)]
    posts = index.tiers(spark.createDataFrame(rows, "field string, term string, doc_id string, tf long"))
    assert Counter(r.tier for r in posts.collect()) == {1: 3, 2: 3, 3: 4}
    scores = posts.select(F.lit(1).alias("query_id"), "field", "tier", "doc_id", F.lit(1.0).alias("score"))
    for least, n in ((1, 3), (3, 3), (4, 6), (7, 10), (99, 10)):
        assert search.tiered(scores, least).count() == n


def test_weights():
    assert search.weights_of([0.5]) == {"characters": 0.5, "genres": 0.0, "description": 0.0}
    assert search.weights_of({"genres": 2}) == {"characters": 0.0, "genres": 2.0, "description": 0.0}
    assert set(search.weights_of(None).values()) == {1.0}


def test_spelling(spark):
    docs = spark.createDataFrame([("magic wizard school adventure fantasy",), ("space voyage alien planet science fiction",)], "t string")
    vocab = spelling.vocabulary(docs, F.col("t"))
    q = spark.createDataFrame([(1, "magik wizrd schol"), (2, "Magik, (SPACE) !"), (3, ""), (4, None), (5, "zzz")], "query_id int, query string")
    got = {r.query_id: r.corrected for r in spelling.spell_check(q, vocab).collect()}
    assert got == {1: "magic wizard school", 2: "Magic, (Space) !", 3: "", 4: "", 5: "zzz"}


def test_snippets():
    doc = "A young wizard enters a school of magic. Many years pass quietly there. At last he meets the dark lord in a tower."
    text, missing = snippets.snippet(doc, "wizard magic lord", 3)
    assert all(f"***{w}***" in text for w in ("wizard", "magic", "lord")) and missing == []
    assert snippets.snippet("", "magic of dragons") == ("", ["dragon", "magic"])
    assert snippets.snippet(doc, "the of") == (doc[:300], [])
    assert snippets.snippet("one two three, four", "zebra", 1) == ("one two three", ["zebra"])


def test_search_with_snippets(spark, engine, books):
    docs = books.select(F.col("id").alias("doc_id"), F.col("description").alias("text"))
    vocab = spelling.vocabulary(docs, F.col("text"))
    q = spark.createDataFrame([(1, "magik school")], "query_id int, query string")
    got = snippets.search_with_snippets(engine, q, docs, vocab, 2).collect()
    assert {r.corrected for r in got} == {"magic school"} and all("***" in r.snippet.text for r in got)


def test_identical_documents_share_buckets(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, "a wholly different line of words"), (3, None)], "id int, t string")
    s = near_duplicates.signatures(docs, "id", "t")
    pairs = {(r.a, r.b): r.n_shared_bands for r in near_duplicates.band_pairs(s, 25, 4).collect()}
    assert pairs == {(0, 1): 25}
    sig = {r.doc_id: r.hashes for r in s.collect()}
    assert sig[3] == [0] * 100
    import zlib

    b = {(r.doc_id, r.band): r.bucket for r in near_duplicates.buckets(s, 25, 4).collect()}
    assert b[(2, 3)] == f"3:{zlib.crc32(repr((3, tuple(sig[2][12:16]))).encode())}"
    one = {(r.doc_id, r.band): r.bucket for r in near_duplicates.buckets(s, 100, 1).collect()}
    assert one[(2, 7)] == f"7:{zlib.crc32(repr((7, (sig[2][7],))).encode())}"
    assert near_duplicates.bands_of(24) == (24, 1)


@pytest.mark.parametrize("kind", ["naive", "dirichlet", "jm"])
@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_best_by_language_model_without_all_documents(spark, kind, k):
    words = ["a1", "b1", "c1", "d1"]
    rows = [(i, [words[(i * j) % 4] for j in range(i % 5)], [words[i % 4]] * (i % 2)) for i in range(40)]
    docs = spark.createDataFrame(rows, "id int, x array<string>, y array<string>")
    t = index.field_terms(docs, "id", {"description": F.col("x"), "genres": F.col("y")})
    q = spark.createDataFrame([(1, "a1", 2), (1, "zz", 1), (2, "c1", 1), (3, "zz", 1)], "query_id int, term string, qtf long")
    lengths, posts = index.doc_lengths(t), index.postings(t)
    w = {"description": 0.7, "genres": 0.3, "characters": 0.0}
    shown = lambda s: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in s.collect())
    want = shown(ranking.top_k(search.aggregate(ranking.language_model(posts, q, lengths, kind), w), k))
    assert shown(ranking.language_top(posts, q, lengths, k, kind, weights=w)) == want
    only = index.postings(t, only=q)
    assert shown(ranking.language_top(only, q, lengths, k, kind, weights=w, clen=index.field_sizes(lengths))) == want
    assert len(want) == 3 * min(k, 40)


def test_average_length_by_alias(spark):
    t = spark.createDataFrame([("genres_document_length", 2.5), ("document_length", 9.0), ("genres", None)], "field string, avgdl double")
    got = [index.average_length(s, f).first().avgdl for s, f in ((t.where("avgdl > 0"), "genres"), (t, "genres"), (t, "characters"), (t.limit(0), "genres"))]
    assert got == [2.5, 0.0, 9.0, 0.0]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_signatures_by_chunks_and_ranges(spark, monkeypatch, k):
    for name in ("CHUNK_WORDS", "CHUNK_ROWS", "RANGE_ROWS"):
        monkeypatch.setattr(near_duplicates, name, 7)
    words = ["a", "ab", "b", "a1", "z"]
    texts = [" ".join(words[(i * j + j // 3) % 5] for j in range(i % 9)) for i in range(40)] + [None, "", "A ab", "İ x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sets = {r.id: r.s for r in docs.select("id", T.shingles(F.col("t"), k).alias("s")).collect()}
    row = {x: i for i, x in enumerate(sorted({x for s in sets.values() for x in s}))}
    want = {i: [min(((a * row[x] + b) % near_duplicates.PRIME for x in s), default=0) for a, b in near_duplicates.hash_params(30)] for i, s in sets.items()}
    t = near_duplicates.profiles(docs, "id", "t", 30, k)
    assert {r.doc_id: r.hashes for r in t.collect()} == want
    assert {r.doc_id: near_duplicates._unpack(r.rows).tolist() for r in t.collect()} == {i: sorted(row[x] for x in s) for i, s in sets.items()}
    plan = near_duplicates.signatures(docs, "id", "t", 30, k)._jdf.queryExecution().executedPlan().toString()
    assert "shingle" not in plan and "Generate" not in plan  # no row for each document and shingle


def test_signatures_leave_neither_texts_nor_rows_on_disk(spark, monkeypatch):
    made, seen = [], []

    def spy(df, *by, real=near_duplicates.stored, **options):
        seen.append((df.columns, [x.where("shingles is not null").count() if os.path.exists(f"{x._stored_at.removeprefix('file://')}/head=true") else 0 for x in made if "shingles" in x.columns]))
        made.append(real(df, *by, **options))
        return made[-1]

    monkeypatch.setattr(near_duplicates, "stored", spy)
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b"), (2, None)], "id int, t string")
    s = near_duplicates.signatures(docs, "id", "t")
    assert seen[1][1] != [0]
    assert seen[-1] == (["doc_id", "hashes"], [0])  # the texts are gone before signatures are written, without rows
    assert near_duplicates.buckets(s, 25, 4).count() == 75


def test_least_values_by_blocks_and_texts_joined(monkeypatch):
    row = np.arange(0, 90_000_000, 1_000_003)
    places = [np.arange(i % 5, 90, 1 + i % 11)[: i % 13] for i in range(60)]
    want = [[min(((a * int(row[x]) + b) % near_duplicates.PRIME for x in p), default=0) for a, b in near_duplicates.hash_params(30)] for p in places]
    for most in (1, 20, 1 << 14):
        monkeypatch.setattr(near_duplicates, "HASH_ROWS", most)
        assert near_duplicates._least(row, places, 30).tolist() == want
    assert near_duplicates._least(row[:0], [row[:0]], 2).tolist() == [[0, 0]]
    for x in (pa.array(["a", "a b", "z9"]), pa.array(["0", "a", "b ż", "c"], pa.large_string()).slice(1, 2)):
        assert near_duplicates._unlines(near_duplicates._lines(x)).to_pylist() == x.to_pylist()


def test_band_pairs_join_only_shared_bands(spark):
    sigs = spark.createDataFrame([(i, [i % 3, i // 4, 7, i]) for i in range(12)] + [(20, [0, 0, 7, 0])], "doc_id int, hashes array<long>")
    rows = {r.doc_id: r.hashes for r in sigs.collect()}
    want = {(a, b): n for a in rows for b in rows if a < b and (n := sum(x == y for x, y in zip((rows[a][:2], rows[a][2:]), (rows[b][:2], rows[b][2:]), strict=True)))}
    t = near_duplicates.band_pairs(sigs, 2, 2)
    assert {(r.a, r.b): r.n_shared_bands for r in t.collect()} == want
    assert "inline" not in t._jdf.queryExecution().executedPlan().toString()  # bands that one signature has alone aren't joined


def test_similarity_of_pairs_from_numbers(spark):
    docs = spark.createDataFrame([(0, "a b c d e"), (1, "a b c d e"), (2, "a b c d f"), (3, None), (4, "")], "id int, t string")
    t = near_duplicates.near_duplicates(docs, "id", "t")
    got = {(r.a, r.b): r.jaccard for r in t.collect()}
    assert got[0, 1] == got[3, 4] == 1.0 and got.get((0, 2), 0.6) == 0.6
    assert "array_distinct" not in t._jdf.queryExecution().executedPlan().toString()


def test_quality_reads_numbers_not_texts(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b c"), (5, "x y"), (6, None)], "id int, t string")
    pairs = spark.createDataFrame([(0, 1), (0, 1), (5, 6)], "a int, b int")
    t = near_duplicates.quality(docs, pairs, "id", "t")
    assert t.first().asDict() == {"pairs": 2, "quality": 0.5}
    assert "array_distinct" not in t._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_quality_sends_sets_to_blocks_not_to_pairs(spark, monkeypatch, most):
    words = [f"w{i}" for i in range(6)]
    texts = {i: " ".join(words[(i * j + j // 3) % 6] for j in range(i % 9)) if i % 10 else None for i in range(60) if i % 7}
    docs = spark.createDataFrame([(i, x) for i, x in texts.items()] + [(13, "w0 w1 w2")], "id int, t string")  # 13 twice
    pairs = spark.createDataFrame([(a, b) for a in texts for b in range(a + 1, 62) if (a + b) % 4 == 0] + [(1000, 1), (1, None)], "a int, b int")
    sets = {}
    for r in docs.select("id", T.shingles(F.col("t")).alias("s")).collect():
        sets.setdefault(r.id, []).append(set(r.s or ()))
    draws = pairs.select("a", "b", *[(F.pmod(F.xxhash64("a", "b", F.lit(i)), F.lit(max(texts) - min(texts) + 1)) + min(texts)).alias(f"c{i}") for i in range(1, 6)]).collect()
    like = lambda a, c: max(len(x & y) / len(x | y) if x | y else 1.0 for x in sets[a] for y in sets.get(c, [set()]))
    won = [like(a, b) > max((-1.0 if c in (a, b) else like(a, c) for c in cs), default=-1.0) for a, b, *cs in draws if a in sets]
    monkeypatch.setattr(near_duplicates, "BLOCKS", 3)
    t = near_duplicates.quality(docs, pairs, "id", "t", most=most)
    assert t.first().asDict() == {"pairs": len(won), "quality": sum(won) / len(won)} and 0 < sum(won) < len(won)
    assert near_duplicates.quality(docs, pairs.limit(0), "id", "t", most=most).first().asDict() == {"pairs": 0, "quality": None}
    assert "ArrowEvalPython" not in t._jdf.queryExecution().executedPlan().toString()  # no row holds the sets of a pair


def test_sketches_bound_similarity():
    sets = [np.unique(np.arange(n) ** 2 * s + o) for n in (0, 1, 5, 63, 64, 65, 400, 3000) for s in (1, 3) for o in (0, 7)]
    read = [near_duplicates._read_sketch(near_duplicates._sketch(x)) for x in sets]
    for x, p in zip(sets, read, strict=True):
        for y, q in zip(sets, read, strict=True):
            both = len(np.intersect1d(x, y))
            exact = both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0
            assert near_duplicates._overlap(x, y) == exact <= near_duplicates._most_overlap(p, q)
    assert near_duplicates._most_overlap(near_duplicates._read_sketch(b""), read[0]) == 1.0
    assert near_duplicates._most_overlap(read[-4], near_duplicates._read_sketch(near_duplicates._sketch(np.arange(10_000_000, 10_003_000)))) < 0.3


def test_shuffle_files_go_when_a_query_ends(spark):
    key = spark._jvm.org.apache.spark.sql.internal.SQLConf.CLASSIC_SHUFFLE_DEPENDENCY_FILE_CLEANUP_ENABLED().key()
    was = spark.conf.get(key)
    with freed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == was
