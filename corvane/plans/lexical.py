"""Queries of the lexical operators over ``documents``, ``benchmark`` and ``pages``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import stemming
from corvane.functions import text as T
from corvane.operators import index, near_duplicates, ranking, search, snippets, spelling
from corvane.plans import sql as S
from corvane.session import freed, spread, stored

MISSPELT = ("thinge", "woth", "eratiom", "blehere", "enton", "zzqx")
SENTENCES = ("Thinge with erath!", "(woth) Ereath, unknwon", "the onand")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return index.field_terms(_docs(spark, d), "doc_id", {"description": T.terms(F.col("text"))})


def _three(spark: SparkSession, d: str) -> DataFrame:
    return index.field_terms(_docs(spark, d), "doc_id", {"description": T.terms(F.col("text")), "genres": T.terms(F.col("lang")), "characters": T.terms(F.col("source"))})


def _search_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms, written: ranking reads them for postings, frequencies and lengths."""
    return stored(_terms(spark, d))


def _search_three(spark: SparkSession, d: str) -> DataFrame:
    return stored(_three(spark, d))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return ranking.query_terms(table(spark, d, "benchmark"), "item_id", T.terms(F.col("text")))


def _field_queries(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" en src"), (F.col("item_id") % 20).cast("string"))
    return ranking.query_terms(table(spark, d, "benchmark"), "item_id", T.terms(text))


def _ranked(scores: DataFrame, k: int = 10) -> DataFrame:
    return ranking.top_k(scores, k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tokenize(spark, d):
    t = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.get("w", F.lit(0)).alias("first_tok"), F.get("w", F.size("w") - 1).alias("last_tok"))


def normalize_suffix(spark, d):
    t = _docs(spark, d).select("doc_id", T.terms(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_terms"), F.size(F.array_distinct("w")).alias("n_distinct"))


def preprocess_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.preprocess(F.col("text")).alias("text"))


def remove_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.without_links(F.concat("url", F.lit(" "), F.regexp_replace("html", "[^ -~]", " ")))).cast("long").alias("n_left"))


def porter_terms(spark, d):
    words = _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return stemming.porter_terms(words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))).groupBy("stem").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_words"))


def split_list(spark, d):
    v = F.concat(F.lit("["), F.col("p_name"), F.lit(" | '"), F.col("p_type"), F.lit("';  "), F.col("p_brand"), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.split_list(v), "~").alias("items"))


def documents_index(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    return index.latest(t, "id", "turn").select("id", "turn", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def inverted_index(spark, d):
    return index.postings(_terms(spark, d)).select("term", "doc_id", "tf")


def posting_lookup(spark, d):
    return index.lookup(index.postings(_terms(spark, d)), ["th", "er", "on", "tion", "idiot"]).select("term", "doc_id", "tf")


def doc_lengths(spark, d):
    return index.doc_lengths(_three(spark, d))


def field_stats(spark, d):
    return index.field_stats(index.doc_lengths(_three(spark, d))).select("field", F.round("avgdl", 6).alias("avgdl"), "n_docs")


def tiers(spark, d):
    return index.tiers(index.postings(_three(spark, d))).groupBy("field", "tier").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("tf"))


def _version(spark, d):
    """The documents whose identifiers a pair of rows in ``labels`` marks as low quality get the text of the benchmark instead."""
    low = table(spark, d, "labels").where("quality = 0").select("doc_id")
    n = table(spark, d, "benchmark")
    new = low.join(n, F.col("doc_id") == F.col("item_id")).select("doc_id", "text")
    return index.field_terms(new, "doc_id", {"description": T.terms(F.col("text"))})


def index_add(spark, d):
    return index.add_documents(index.postings(_terms(spark, d)), index.postings(_version(spark, d))).select("term", "doc_id", "tf")


def index_remove(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return index.remove_documents(index.postings(_terms(spark, d)), toxic).select("term", "doc_id", "tf")


def index_self_check(spark, d):
    terms = _terms(spark, d)
    return index.self_check(index.postings(terms), terms).agg(F.count(F.lit(1)).alias("n_differences"))


def idf(spark, d):
    t = _search_terms(spark, d)
    n = index.field_stats(index.doc_lengths(t)).select("n_docs")
    stats = index.term_stats(index.postings(t)).join(F.broadcast(n), how="cross")  # one row
    return stats.select("term", "df", "cf", F.round(ranking.idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))


def _vsm(method: str):
    def run(spark, d):
        t, q = _search_terms(spark, d), stored(_queries(spark, d))
        posts = stored(index.postings(t, only=q))  # read for frequencies and for matches
        return _ranked(ranking.vector_space(posts, q, index.field_stats(index.doc_lengths(t)), method))

    return run


def bm25_topk(spark, d):
    t, q = _search_terms(spark, d), stored(_queries(spark, d))
    lengths = index.doc_lengths(t)
    return _ranked(ranking.bm25(stored(index.postings(t, only=q)), q, lengths, index.field_stats(lengths)))


def bm25_fields(spark, d):
    t, q = _search_three(spark, d), stored(_field_queries(spark, d))
    lengths = index.doc_lengths(t)
    scores = ranking.bm25(stored(index.postings(t, only=q)), q, lengths, index.field_stats(lengths))
    return _ranked(search.aggregate(scores, search.weights_of([0.3, 0.3, 0.4])))


def vsm_fields(spark, d):
    t, q = _search_three(spark, d), stored(_field_queries(spark, d))
    scores = ranking.vector_space(stored(index.postings(t, only=q)), q, index.field_stats(index.doc_lengths(t)), "ltn.lnn")
    return _ranked(search.aggregate(scores, search.weights_of({"description": 0.6, "genres": 0.2, "characters": 0.2})))


def tiered_search(spark, d):
    t, q = _search_three(spark, d), stored(_field_queries(spark, d))
    posts = index.tiers(stored(index.postings(t, only=q)))
    scores = ranking.vector_space(posts, q, index.field_stats(index.doc_lengths(t)), "ltn.lnn", extra=("tier",))
    return _ranked(search.aggregate(search.tiered(scores, 10), search.weights_of([0.3, 0.3, 0.4])))


def _lm(smoothing: str):
    def run(spark, d):
        t, q = _search_terms(spark, d), stored(_queries(spark, d))
        lengths = stored(index.doc_lengths(t))
        top = ranking.language_top(stored(index.postings(t, only=q)), q, lengths, 10, smoothing, clen=index.field_sizes(lengths))
        return top.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")

    return run


def vocab(spark, d):
    return spelling.vocabulary(_docs(spark, d), F.col("text"), F.col("lang"), F.col("source"))


def kgrams(spark, d):
    return spelling.grams(vocab(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"), F.min("word").alias("first_word"))


def spell_candidates(spark, d):
    words = spark.createDataFrame([(w,) for w in MISSPELT], "word string")
    return spelling.candidates(words, stored(vocab(spark, d))).select("word", "candidate", F.round("score", 6).alias("score"), "rank")


def spell_check(spark, d):
    q = spark.createDataFrame(list(enumerate(SENTENCES)), "query_id long, query string")
    return spelling.spell_check(q, stored(vocab(spark, d)))


def shingles(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"))


def minhash(spark, d):
    t = near_duplicates.signatures(_docs(spark, d), "doc_id", "text")
    return t.select("doc_id", F.posexplode("hashes").alias("hash_idx", "minhash"))


def lsh_band_pairs(spark, d):
    return near_duplicates.band_pairs(near_duplicates.signatures(_docs(spark, d), "doc_id", "text"), 25, 4)


def lsh_buckets(spark, d):
    t = near_duplicates.buckets(near_duplicates.signatures(_docs(spark, d), "doc_id", "text"), 25, 4)
    return t.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n_docs"))


def jaccard_pairs(spark, d):
    t = near_duplicates.near_duplicates(_docs(spark, d), "doc_id", "text")
    return t.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def lsh_quality(spark, d):
    docs = _docs(spark, d)
    with freed(spark):
        t = near_duplicates.profiles(docs, "doc_id", "text")
        return near_duplicates.quality(docs, near_duplicates.band_pairs(t.select("doc_id", "hashes"), 25, 4), "doc_id", "text", rows=t)


def snippet_missing(spark, d):
    """Query terms that the best document of each query lacks."""
    best = bm25_topk(spark, d).where("rank = 1").select("query_id", "doc_id")
    t = best.join(_docs(spark, d).select("doc_id", F.col("text").alias("doc")), "doc_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return snippets.snippets(t, F.col("doc"), F.col("query")).select("query_id", "doc_id", "snippet.text", F.array_join("snippet.missing", " ").alias("missing"))


def search_engine(spark, d):
    """The engine's batch search with its defaults."""
    docs = _docs(spark, d)
    fields = {"description": T.terms(F.col("text")), "genres": T.terms(F.col("lang")), "characters": T.terms(F.col("source"))}
    terms = stored(index.field_terms(docs, "doc_id", fields))
    engine = search.SearchEngine(index.tables(terms), docs)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" en src"), (F.col("item_id") % 20).cast("string")).alias("query"))
    return engine.search(q).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {
    f.__name__: f
    for f in (tokenize, normalize_suffix, preprocess_text, remove_links, porter_terms, split_list, documents_index, inverted_index, posting_lookup, doc_lengths, field_stats, tiers, index_add, index_remove, index_self_check, idf, bm25_topk, bm25_fields, vsm_fields, tiered_search, vocab, kgrams, spell_candidates, spell_check, shingles, minhash, lsh_band_pairs, lsh_buckets, jaccard_pairs, lsh_quality, snippet_missing, search_engine)
}
QUERIES |= {"vsm_ltn_lnn": _vsm("ltn.lnn"), "vsm_ltc_lnc": _vsm("ltc.lnc"), "vsm_lnc_ltc": _vsm("lnc.ltc"), "vsm_btn_atn": _vsm("btn.atn"), "lm_naive": _lm("naive"), "lm_dirichlet": _lm("dirichlet"), "lm_jm": _lm("jm")}

_I, _FI = f"WITH {S.INDEX}", f"WITH {S.FIELD_INDEX}"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_VOCAB = f"vocab AS MATERIALIZED (SELECT word, count(*) AS cnt FROM (SELECT unnest({_WORDS.format('text')} || {_WORDS.format('lang')} || {_WORDS.format('source')}) AS word FROM documents) GROUP BY 1)"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('$' || {0} || '$', i::INT, 2)))"


def _tf(x: str, letter: str) -> str:
    w = {"l": f"1 + ln({x}::DOUBLE)", "b": "1.0", "a": f"0.5 + 0.5 * {x}"}.get(letter, f"{x}::DOUBLE")
    return f"CASE WHEN {x} > 0 THEN {w} ELSE 0.0 END"


def _vsm_sql(index_: str, method: str, field: bool = False) -> str:
    d, q = method.split(".")
    f, on = ("field, ", "p.field = w.field AND ") if field else ("", "")
    i = lambda n: f"(ln((n + 1)::DOUBLE / (coalesce({n}, 0) + 1)) + 1)"
    dfj = "LEFT JOIN df ON df.term = q.term AND df.field = st.field" if field else "LEFT JOIN df ON df.term = q.term"
    stf = "st.field, " if field else ""
    qw, dw = _tf("qtf", q[0]) + (f" * {i('df')}" if q[1] == "t" else ""), _tf("tf", d[0]) + (f" * {i('df')}" if d[1] == "t" else "")
    qn = "qw / nullif(sqrt(sum(qw * qw) OVER (PARTITION BY " + f + "query_id)), 0)" if q[2] == "c" else "qw"
    score = "sum(dw * qw) / nullif(sqrt(sum(dw * dw)), 0)" if d[2] == "c" else "sum(dw * qw)"
    return f"""{index_},
w0 AS (SELECT {stf}q.query_id, q.term, df, n, {qw} AS qw FROM q CROSS JOIN st {dfj}),
w AS (SELECT * REPLACE ({qn} AS qw) FROM w0),
m AS (SELECT {'p.field, ' if field else ''}query_id, doc_id, {dw} AS dw, qw FROM post p JOIN w ON {on}p.term = w.term),
s AS (SELECT {f}query_id, doc_id, {score} AS score FROM m GROUP BY ALL HAVING {score} <> 0)"""


_BM25 = "sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE greatest(dl, 1) END)))"
_BM25_FIELDS = f"s0 AS (SELECT field, query_id, doc_id, {_BM25} AS score FROM post JOIN q USING (term) JOIN df USING (field, term) JOIN lens USING (field, doc_id) JOIN st USING (field) GROUP BY ALL)"
_W = "s AS (SELECT query_id, doc_id, sum(score * CASE field WHEN 'characters' THEN {0} WHEN 'genres' THEN {1} ELSE {2} END) AS score FROM s0 GROUP BY ALL)"


def _lm_sql(kind: str) -> str:
    p = {"naive": "tf / dl0", "dirichlet": "(tf + mu * pc) / (dl0 + mu)", "jm": "0.5 * (tf / dl0) + 0.5 * pc"}[kind]
    return f"""{_I},
cl AS (SELECT greatest(sum(cf), 1)::DOUBLE AS clen FROM df),
w AS (SELECT query_id, q.term, qtf, coalesce(cf, 0) / clen AS pc, 0.5 * greatest(clen / n, 1.0) AS mu FROM q LEFT JOIN df ON df.term = q.term CROSS JOIN cl CROSS JOIN st),
x AS (SELECT w.*, l.doc_id, greatest(l.dl, 1)::DOUBLE AS dl0, coalesce(p.tf, 0)::DOUBLE AS tf FROM w CROSS JOIN lens l LEFT JOIN post p ON p.term = w.term AND p.doc_id = l.doc_id),
s AS (SELECT query_id, doc_id, sum(qtf * ln(greatest({p}, 1e-12))) AS score FROM x GROUP BY ALL) {S.top('s')}"""


_SHINGLES = "sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) > 0))"
_MIN = f"""{_SHINGLES},
dict AS (SELECT shingle, row_number() OVER (ORDER BY shingle) - 1 AS r FROM (SELECT DISTINCT shingle FROM sh)),
hp AS (SELECT i, ((1103515245 + 2 * i * 12345) % 4294967311)::BIGINT AS a, ((12345 + i * 2654435761::BIGINT) % 4294967311)::BIGINT AS b FROM range(100) t(i)),
mh AS MATERIALIZED (SELECT d.doc_id, hp.i AS hash_idx, coalesce(min((a * r + b) % 4294967311), 0)::BIGINT AS minhash FROM documents d CROSS JOIN hp LEFT JOIN (SELECT doc_id, r FROM sh JOIN dict USING (shingle)) x ON x.doc_id = d.doc_id GROUP BY ALL),
bands AS MATERIALIZED (SELECT doc_id, hash_idx // 4 AS band, list(minhash ORDER BY hash_idx) AS part FROM mh GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared_bands FROM bands x JOIN bands y ON x.band = y.band AND x.part = y.part AND x.doc_id < y.doc_id GROUP BY ALL)"""
_FIND = f"""c AS (SELECT w.word, v.word AS candidate, cnt, len(list_intersect({_GRAMS.format('w.word')}, {_GRAMS.format('v.word')})) AS inter, len({_GRAMS.format('w.word')}) + len({_GRAMS.format('v.word')}) AS both_, (SELECT max(cnt) FROM vocab) AS most FROM w CROSS JOIN vocab v WHERE w.word NOT IN (SELECT word FROM vocab)),
c2 AS (SELECT *, inter / (both_ - inter)::DOUBLE AS jac, 0.75 * inter / (both_ - inter)::DOUBLE + 0.20 * cnt / most + 0.05 / (1.0 + abs(length(candidate) - length(word))) AS score FROM c WHERE inter > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(score, 12) DESC, round(jac, 12) DESC, cnt DESC, candidate DESC) AS rank FROM c2)"""

_CAND = f"{_VOCAB}, w AS (SELECT unnest([{', '.join(S.quoted(w) for w in MISSPELT)}]) AS word), {_FIND}"
_CHECKED = f"""{_VOCAB},
s AS (SELECT * FROM (VALUES {', '.join(f"({i}, {S.quoted(t)})" for i, t in enumerate(SENTENCES))}) v(query_id, query)),
tk AS (SELECT query_id, i, tok[i] AS token FROM (SELECT query_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM (SELECT query_id, string_split(query, ' ') AS tok FROM s))),
p AS (SELECT *, regexp_extract(token, '^[^\\p{{L}}\\p{{N}}_]*') AS prefix, regexp_extract(token, '[^\\p{{L}}\\p{{N}}_]*$') AS suffix FROM tk),
k AS (SELECT *, substr(token, length(prefix) + 1, length(token) - length(prefix) - length(suffix)) AS core FROM p),
w AS (SELECT DISTINCT lower(core) AS word FROM k WHERE core <> ''), {_FIND},
x AS (SELECT k.*, coalesce(candidate, lower(core)) AS best FROM k LEFT JOIN r ON r.word = lower(core) AND r.rank = 1)"""

ORACLE_SQL = {
    "tokenize": f"SELECT doc_id, len(w) AS n_tokens, w[1] AS first_tok, w[-1] AS last_tok FROM (SELECT doc_id, {S.tokens('text')} AS w FROM documents)",
    "normalize_suffix": f"SELECT d.doc_id, count(term) AS n_terms, count(DISTINCT term) AS n_distinct FROM documents d LEFT JOIN ({S.terms(S.DOCS)}) t ON t.k = d.doc_id GROUP BY 1",
    "preprocess_text": f"SELECT item_id, array_to_string(list_filter(list_transform(list_filter({S.tokens('text')}, lambda w: w NOT IN {S.STOP}), lambda w: {S.stem('w')}), lambda w: w <> '' AND w NOT IN {S.STOP}), ' ') AS text FROM benchmark",
    "remove_links": f"SELECT page_id, length(regexp_replace(url || ' ' || regexp_replace(html, '[^ -~]', ' ', 'g'), {S.quoted(T.LINK)}, ' ', 'gi')) AS n_left FROM pages",
    "split_list": "SELECT p_partkey, p_name || '~' || p_type || '~' || p_brand AS items FROM part",
    "documents_index": "SELECT conv_id::VARCHAR AS id, turn, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "inverted_index": f"{_I} SELECT term, doc_id, tf FROM post",
    "posting_lookup": f"{_I} SELECT term, doc_id, tf FROM post WHERE term IN ('th', 'er', 'on', 'tion', 'idiot')",
    "doc_lengths": f"{_FI} SELECT field, doc_id, dl FROM lens",
    "field_stats": f"{_FI} SELECT field, round(avgdl, 6) AS avgdl, n AS n_docs FROM st",
    "tiers": f"""{_FI} SELECT field, tier, count(*) AS n_postings, sum(tf)::BIGINT AS tf FROM (SELECT *, CASE WHEN tf >= CASE field WHEN 'characters' THEN 3 WHEN 'description' THEN 10 ELSE 1 END THEN 1 WHEN tf >= CASE field WHEN 'characters' THEN 2 WHEN 'description' THEN 5 ELSE 0 END THEN 2 ELSE 3 END AS tier FROM post) GROUP BY ALL""",
    "index_add": f"""{_I}, nw AS (SELECT k AS doc_id, term, count(*) AS tf FROM ({S.terms("SELECT doc_id AS k, text AS s FROM labels JOIN benchmark ON doc_id = item_id WHERE quality = 0")}) GROUP BY ALL)
SELECT term, doc_id, tf FROM nw UNION ALL SELECT term, doc_id, tf FROM post ANTI JOIN nw USING (term, doc_id)""",
    "index_remove": f"{_I} SELECT term, doc_id, tf FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "index_self_check": "SELECT 0 AS n_differences",
    "idf": f"{_I} SELECT term, df, cf::BIGINT AS cf, round(ln((n + 1)::DOUBLE / (df + 1)) + 1, 6) AS idf FROM df CROSS JOIN st",
    **{f"vsm_{m.replace('.', '_')}": f"{_vsm_sql(_I, m)} {S.top('s')}" for m in ("ltn.lnn", "ltc.lnc", "lnc.ltc", "btn.atn")},
    "bm25_topk": f"{_I}, s AS (SELECT query_id, doc_id, {_BM25} AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN st GROUP BY ALL) {S.top('s')}",
    "bm25_fields": f"{_FI}, {_BM25_FIELDS}, {_W.format(0.3, 0.3, 0.4)} {S.top('s')}",
    "vsm_fields": f"{_vsm_sql(_FI, 'ltn.lnn', True).replace('s AS (SELECT field', 's0 AS (SELECT field')}, {_W.format(0.2, 0.2, 0.6)} {S.top('s')}",
    "search_engine": f"{_vsm_sql(_FI, 'ltn.lnn', True).replace('s AS (SELECT field', 's0 AS (SELECT field')}, {_W.format(0.3, 0.3, 0.4)} {S.top('s')}",
    "tiered_search": f"""{_FI},
tp AS MATERIALIZED (SELECT *, CASE WHEN tf >= CASE field WHEN 'characters' THEN 3 WHEN 'description' THEN 10 ELSE 1 END THEN 1 WHEN tf >= CASE field WHEN 'characters' THEN 2 WHEN 'description' THEN 5 ELSE 0 END THEN 2 ELSE 3 END AS tier FROM post),
tdf AS (SELECT field, tier, term, count(*) AS df FROM tp GROUP BY ALL),
m AS (SELECT field, tier, query_id, doc_id, sum((1 + ln(tf::DOUBLE)) * (ln((n + 1)::DOUBLE / (df + 1)) + 1) * (1 + ln(qtf::DOUBLE))) AS score FROM tp JOIN q USING (term) JOIN tdf USING (field, tier, term) JOIN st USING (field) GROUP BY ALL),
fd AS (SELECT query_id, doc_id, min(tier) AS tier FROM m GROUP BY ALL),
stop_ AS (SELECT query_id, min(tier) AS stop_at FROM (SELECT query_id, tier, sum(n) OVER (PARTITION BY query_id ORDER BY tier) AS upto FROM (SELECT query_id, tier, count(*) AS n FROM fd GROUP BY ALL)) WHERE upto >= 10 GROUP BY 1),
s0 AS (SELECT field, query_id, doc_id, score FROM m LEFT JOIN stop_ USING (query_id) WHERE stop_at IS NULL OR tier <= stop_at), {_W.format(0.3, 0.3, 0.4)} {S.top('s')}""",
    **{f"lm_{k}": _lm_sql(k) for k in ("naive", "dirichlet", "jm")},
    "vocab": f"WITH {_VOCAB} SELECT word, cnt FROM vocab",
    "kgrams": f"WITH {_VOCAB} SELECT gram, count(*) AS n_words, min(word) AS first_word FROM (SELECT word, unnest({_GRAMS.format('word')}) AS gram FROM vocab) GROUP BY 1",
    "spell_candidates": f"WITH {_CAND} SELECT word, candidate, round(score, 6) AS score, rank FROM r WHERE rank <= 5 UNION ALL SELECT word, word, NULL, 1 FROM w WHERE word NOT IN (SELECT word FROM r)",
    "spell_check": f"WITH {_CHECKED} SELECT query_id, string_agg(prefix || CASE WHEN left(core, 1) <> lower(left(core, 1)) THEN upper(left(best, 1)) || lower(substr(best, 2)) ELSE best END || suffix, ' ' ORDER BY i) AS corrected FROM x GROUP BY 1",
    "shingles": f"WITH {_SHINGLES} SELECT d.doc_id, count(shingle) AS n_shingles FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY 1",
    "minhash": f"WITH {_MIN} SELECT doc_id, hash_idx, minhash FROM mh",
    "lsh_band_pairs": f"WITH {_MIN} SELECT a, b, n_shared_bands FROM pairs",
    "jaccard_pairs": f"""WITH {_MIN}, sets AS (SELECT d.doc_id, count(shingle) AS n FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY 1),
i AS (SELECT a, b, count(*) AS n FROM pairs JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.shingle = y.shingle GROUP BY ALL)
SELECT a, b, round(CASE WHEN p.n + q.n = 0 THEN 1.0 ELSE coalesce(i.n, 0) / (p.n + q.n - coalesce(i.n, 0))::DOUBLE END, 6) AS jaccard FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b LEFT JOIN i USING (a, b)""",
}
