import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.stemming import porter, porter_terms
from corvane.operators import snippets

WORDS = "a b'c Don't www.x.org end.Company see https://a.b/c me@x.y naïve CAFÉ it’s 42nd Running flies classes".split()


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def brute_tokens(t):
    t = re.sub(T.LINK, " ", t or "", flags=re.IGNORECASE)
    return [m.group(0) for m in re.finditer(r"[a-zA-Z0-9]+(?:'[a-zA-Z0-9]+)?", t.lower())]


def test_tokens(spark):
    texts = [None, "", " ".join(WORDS), "end.Company of www.site.com/x, HTTP://q.r x@y", "a b c", "ABC-def_ghi"]
    assert apply(spark, texts, T.tokens) == [brute_tokens(t) for t in texts]


def test_terms_match_the_python_twin(spark):
    texts = ["The running dogs weren't seen with flies and the BEES, lovingly used", "", None, "this that ingly edly eds xies"]
    assert apply(spark, texts, T.terms) == [snippets.query_terms(t) for t in texts]
    words = ["Running,", "“Flies”", "", "--", "dog's'", "x@y.z", "Café"]
    assert apply(spark, words, T.normalize) == [snippets.normalize(w) for w in words]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abcdefiglnysxdé' .-", max_size=25), min_size=1, max_size=10))
def test_terms_of_any_text(spark, texts):
    assert apply(spark, texts, T.terms) == [snippets.query_terms(t) for t in texts]


def test_split_list(spark):
    values = [None, "", "[]", "a, b|c ; 'd'", "['x', \"y\"]", '["p, q", "r"]', "[one, two]", "  "]
    assert apply(spark, values, T.split_list) == [[], [], [], ["a", "b", "c", "d"], ["x", "y"], ["p, q", "r"], ["one", "two"], []]


def test_kgrams_and_shingles(spark):
    assert [sorted(x) for x in apply(spark, ["ab", "", None, "AAA"], T.kgrams)] == [["$a", "ab", "b$"], [], [], ["$a", "a$", "aa"]]
    assert apply(spark, ["One two, one TWO three", "alone", "", None], T.shingles) == [["one two", "two one", "two three"], ["alone"], [], []]


def test_jaccard(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


def test_infer_need(spark):
    df = spark.createDataFrame([("gray fabric sofa for a small living room, not leather",), (None,)], "t string")
    pos, neg = T.infer_need(F.col("t"))
    rows = df.select(pos.alias("p"), neg.alias("n")).collect()
    assert rows[0].p == ["gray fabric sofa for a small living room"] and rows[0].n == ["not leather"]
    assert rows[1].p == [] and rows[1].n == []


def test_product_text(spark):
    df = spark.createDataFrame([("Sofa", " ", None, ["soft", None, "wide"], float("nan")), (None, "", None, None, None)], "title string, brand string, product_text string, bullet_points array<string>, dimensions double")
    out = [r[0] for r in df.withColumn("product_text", F.lit("plain")).select(T.product_text(dict(df.dtypes))).collect()]
    assert out == ["Title: Sofa\nFeatures: soft; wide", "plain"]


def test_query_parts_and_capitals(spark):
    p, c, s = T.query_parts(F.col("v"))
    df = spark.createDataFrame([("(Wizrd!)",), ("...",), ("plain",), ("",)], "v string")
    assert [tuple(r) for r in df.select(p, c, s).collect()] == [("(", "Wizrd", "!)"), ("...", "", "..."), ("", "plain", ""), ("", "", "")]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("feudalism", "feudal"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"), ("be", "be")])
def test_porter_of_the_paper(word, want):
    assert porter(word) == want


def test_porter_terms(spark):
    t = porter_terms(spark.createDataFrame([("running",), ("running",), (None,)], "word string"))
    assert sorted((r.word or "", r.stem or "") for r in t.collect()) == [("", ""), ("running", "run"), ("running", "run")]


def test_highlight_and_shorten(spark):
    assert apply(spark, ["A cat, Cat."], lambda c: T.highlight(c, "cat")) == ["A <mark>cat</mark>, <mark>Cat</mark>."]
    assert apply(spark, ["x" * 36, "y"], T.shorten) == ["x" * 35 + "...", "y"]


def test_corpus_words_use_the_corpus_list(spark):
    t = spark.createDataFrame([("What about the book WHICH myself between would must done, zebra pages",), (None,)], "text string")
    assert [r[0] for r in t.select(T.corpus_words(t.text)).collect()] == [["would", "must", "done", "zebra"], []]
