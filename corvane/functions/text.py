"""Text expressions: all built from Spark functions, so they run inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Links, tokens, stop words and suffixes decide results.
LINK = r"\S*https?://\S*|\S*www\.\S*|\S+\.(?:ir|com|org|net|edu|gov)\S*|\S+@\S+"
TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for",
    "from", "has", "have", "he", "her", "hers", "him", "his", "i", "in",
    "into", "is", "it", "its", "of", "on", "or", "our", "ours", "she",
    "so", "such", "the", "their", "theirs", "them", "they", "to", "was",
    "we", "were", "with", "you", "your", "yours", "not", "no", "than",
    "then", "there", "these", "those", "will", "would", "can", "could",
    "may", "might", "must", "do", "does", "did", "done", "if", "because",
    "while", "during", "over", "under", "again", "further", "once", "here",
    "all", "any", "both", "few", "more", "most", "other", "some", "same",
    "own", "too", "very", "s", "t", "m", "ll", "re", "ve", "d",
    "this", "that", "about", "whom", "being", "where", "why", "had", "should", "each",
)
SUFFIXES = ("ingly", "edly", "ing", "edly", "ed", "ies", "s")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”’‘—–…"
PRODUCT_FIELDS = (
    ("Title", "title"), ("Category", "category_path"), ("Product type", "product_type"), ("Brand", "brand"), ("Color", "color"),
    ("Material", "material"), ("Style", "style"), ("Dimensions", "dimensions"), ("Features", "bullet_points"), ("Description", "description"),
)
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "should", "now",
)
CORPUS_STOPWORDS = (
    "title", "titl", "author", "description", "descript", "genre", "genres", "genr", "place", "places", "goodreads", "goodread",
    "page", "pages", "book", "books", "edition", "editions", "isbn", "cover", "paperback", "hardcover", "kindle", "ebook",
)


def stringify(value: Column, is_list: bool = False) -> Column:
    """Null becomes empty; a list becomes its items joined by spaces, null items empty."""
    return F.coalesce(F.array_join(value, " ", "") if is_list else value.cast("string"), F.lit(""))


def without_links(text: Column) -> Column:
    """Links and addresses become a space. Texts without a sign of one skip the costly pattern."""
    sign = text.rlike(r"(?i)://|www\.|@|\.(?:ir|com|org|net|edu|gov)")
    return F.when(sign, F.regexp_replace(text, f"(?iU){LINK}", " ")).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens in order, with at most one inner apostrophe each."""
    return F.regexp_extract_all(F.lower(without_links(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def suffix_stem(word: Column) -> Column:
    """Drop the first suffix of SUFFIXES that leaves over two characters; ``ies`` becomes ``y``."""
    out, n = None, F.length(word)
    for s in SUFFIXES:
        test = word.endswith(s) & (n > len(s) + 2)
        stem = F.substring(word, F.lit(1), n - len(s))
        stem = F.concat(stem, F.lit("y")) if s == "ies" else stem
        out = F.when(test, stem) if out is None else out.when(test, stem)
    return out.otherwise(word)


def is_stop(word: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    return word.isin(*stop)


def terms(text: Column, stem=suffix_stem, stop: Sequence[str] = STOPWORDS) -> Column:
    """Index terms in order: tokens without stop words, stemmed, again without stop words."""
    kept = F.filter(tokens(text), lambda w: ~is_stop(w, stop))
    return F.filter(F.transform(kept, stem), lambda w: (w != "") & ~is_stop(w, stop))


def normalize(word: Column, stem=suffix_stem) -> Column:
    """One word: lower-cased, without links and outer punctuation, its first token stemmed; empty if there is none."""
    bare = F.btrim(F.trim(without_links(F.lower(F.coalesce(word, F.lit(""))))), F.lit(PUNCTUATION))
    token = F.btrim(F.regexp_extract(bare, TOKEN, 0), F.lit("'"))
    return F.when(token == "", F.lit("")).otherwise(stem(token))


def preprocess(text: Column, stem=suffix_stem) -> Column:
    return F.array_join(terms(text, stem), " ")


def split_list(value: Column) -> Column:
    """Items of a list written as text: brackets stripped, parted at , | or ;, trimmed of space and quotes; a Python or JSON list of strings too."""
    v = F.trim(F.coalesce(value, F.lit("")))
    listed = F.when(v.startswith("[") & v.endswith("]"), F.coalesce(F.from_json(v, "array<string>"), F.from_json(F.translate(v, "'", '"'), "array<string>")))
    items = F.coalesce(listed, F.split(F.btrim(v, F.lit("[]")), r"\s*[,|;]\s*", -1))
    return F.filter(F.transform(items, lambda x: F.btrim(F.trim(F.coalesce(x, F.lit(""))), F.lit("\"'"))), lambda x: x != "")


def kgrams(word: Column, k: int = 2) -> Column:
    """Distinct k-grams of $word$; the whole of a shorter one; none of an empty word."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    padded = F.concat(F.lit("$"), w, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (k - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))
    return F.when(w == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(text: Column, k: int = 2) -> Column:
    """Distinct word k-shingles; fewer than k words make one shingle; no words make none."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        some = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(some))

    return F.get(F.transform(F.array(words(text)), cut), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def record_text(*fields: Column) -> Column:
    """The first of ``fields`` that is not null or empty."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit(""))


def safe_text(value: Column, kind: str = "string") -> Column:
    """Null and NaN become empty, lists join by '; ' without nulls, maps become 'k: v; ...'."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(value, "; "), F.lit(""))
    if kind.startswith("map"):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string")))
        return F.coalesce(F.array_join(pairs, "; "), F.lit(""))
    if kind in ("float", "double"):
        return F.when(value.isNull() | F.isnan(value), F.lit("")).otherwise(value.cast("string"))
    return F.coalesce(value.cast("string"), F.lit(""))


def product_text(types: dict[str, str], limit: int = 6000, dimensions: bool = True, trim: bool = True, fallback: str | None = "product_text") -> Column:
    """'Label: value' lines of the fields that ``types`` (column → type) has and that aren't blank, cut at ``limit``.

    ``dimensions=False, trim=False, fallback=None`` gives the variant of the interactive build.
    """
    lines = []
    for label, name in PRODUCT_FIELDS:
        if name in types and (dimensions or name != "dimensions"):
            value = safe_text(F.col(name), types[name])
            lines.append(F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), F.trim(value) if trim else value)))
    text = F.concat_ws("\n", *lines) if lines else F.lit("")
    if fallback and fallback in types:
        text = F.when(text == "", safe_text(F.col(fallback), types[fallback])).otherwise(text)
    return F.substring(text, 1, limit)


def query_parts(token: Column) -> tuple[Column, Column, Column]:
    """Prefix, core and suffix of a token; prefix and suffix are not word characters."""
    prefix, suffix = F.regexp_extract(token, r"(?U)^\W*", 0), F.regexp_extract(token, r"(?U)\W*$", 0)
    return prefix, F.substring(token, F.length(prefix) + 1, F.greatest(F.length(token) - F.length(prefix) - F.length(suffix), F.lit(0))), suffix


def capitalize_like(word: Column, like: Column) -> Column:
    """``word`` with a leading capital if ``like`` has one."""
    first = F.substring(like, 1, 1)
    return F.when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))).otherwise(word)


def marked_tokens(text: Column) -> Column:
    """Words and single punctuation marks in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+(?:'\w+)?|[^\w\s]"), F.lit(0))


def highlight(text: Column, term: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    import re

    return F.regexp_replace(text, rf"(?iU)\b({re.escape(term)})\b", f"{before}$1{after}")


def infer_need(text: Column) -> tuple[Column, Column]:
    """(positive preferences, negative constraints) of a request, at most six each."""
    t = F.trim(F.coalesce(text, F.lit("")))
    negative = F.transform(F.regexp_extract_all(t, F.lit(r"(?iU)\bnot\s+([^,.;]+)"), F.lit(1)), lambda x: F.concat(F.lit("not "), F.trim(x)))
    rest = F.regexp_replace(t, r"(?iU)\bnot\s+[^,.;]+", "")
    positive = F.filter(F.transform(F.split(rest, r"(?U),|\band\b", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(positive, 1, 6), F.slice(F.array_distinct(negative), 1, 6)


def has_negation(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains(" not "), F.lit(False))


def corpus_words(text: Column, stop: Sequence[str] = ENGLISH_STOPWORDS + CORPUS_STOPWORDS, lemma=None) -> Column:
    """Words for embeddings: English letters only, over two long, no stop words, before and after ``lemma``."""
    ok = lambda w: (F.length(w) > 2) & ~w.isin(*stop)
    split = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", " "), r"\s+"), ok)
    return F.filter(F.transform(split, lemma), ok) if lemma else split


def labelled_line(columns: Sequence[str], labels: Sequence[str]) -> Column:
    """'label value label value ...' of the columns; null values are empty."""
    return F.concat_ws(" ", *[x for c, n in zip(columns, labels, strict=True) for x in (F.lit(n), F.coalesce(F.col(c).cast("string"), F.lit("")))])


def shorten(text: Column, limit: int = 35) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
