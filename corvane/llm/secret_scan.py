"""Secret scans in DataFrame functions: fixed patterns, and entropy over sliding windows."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import narrow

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``width`` or more characters of ``alphabet``; a window of ``width`` is a hit at ``bits`` or more."""

    pattern: str
    alphabet: str
    width: int
    bits: float


CLASSES = (
    CharClass(r"[0-9A-F]{24,}", "0123456789ABCDEF", 24, 3.2),
    CharClass(r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
)
#: A candidate that one of these finds is no secret: words and paths, UUIDs, placeholders, integrity digests.
ALLOW = (
    r"^[^0-9]*$",
    r"^[0-9_+/=-]*$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|your[_-]",
    r"^(sha(1|256|384|512)|md5)[-=]",
    r"^[a-z]+([/_-][a-z0-9]+)+$",
)

_SPAN = "array<struct<start:long,kind:int,end:long>>"


def _walk(text: Column, pattern: str, body) -> Column:
    """Fold over the matches of ``pattern``: body(start, match, i) gives an array of spans for each.

    Splitting at the matches gives what stands between them, so positions in code
    points follow from lengths. Leftmost matches don't overlap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(_SPAN).alias("out"))
    rest = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(_SPAN)), body(start, x)).alias("out"))

    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if "(" in pattern else found
    pairs = F.transform(F.arrays_zip(rest.alias("gap"), found.alias("hit"), groups.alias("group")), lambda x: x)
    pairs = F.slice(pairs, F.lit(1), F.size(found))
    return F.when(text.rlike(pattern), F.coalesce(F.aggregate(pairs, state, step)["out"], F.array().cast(_SPAN))).otherwise(F.array().cast(_SPAN))


def _one(start: Column, end: Column, kind: int) -> Column:
    return F.array(F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns. ASSIGN takes what follows the sign in full before its length is judged."""
    none = F.array().cast(_SPAN)
    assign = _walk(text, ASSIGN, lambda s, x: F.when(F.length(x["group"]) >= 6, _one(s, s + F.length(x["hit"]), 0)).otherwise(none))
    access = _walk(text, ACCESS, lambda s, x: _one(s, s + F.length(x["hit"]), 1))
    hexes = _walk(text, HEX, lambda s, x: _one(s, s + F.length(x["hit"]), 2))
    return F.array_sort(F.concat(assign, access, hexes))


def entropy_windows(candidate: Column, kind: CharClass, at: Column) -> Column:
    """Spans where a window of ``candidate`` reaches the class's entropy; windows that touch are merged.

    The fold keeps the count of each character in the window and the sum of
    n log2 n over them; a step changes two counts. H = log2 width - sum / width.
    """
    w, n = kind.width, len(kind.alphabet)
    f = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    where = lambda i: F.position(F.substring(candidate, i, F.lit(1)), F.lit(kind.alphabet))
    zero = F.array_repeat(F.lit(0), n)
    state = F.struct(zero.alias("c"), F.lit(0.0).alias("s"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        come = where(i)
        go = F.when(i > w, where(i - w)).otherwise(F.lit(0))
        same = come == go
        a, b = F.coalesce(F.get(acc["c"], go - 1), F.lit(0)), F.get(acc["c"], come - 1)
        s = F.when(same, acc["s"]).otherwise(acc["s"] + F.when(go > 0, f(a - 1) - f(a)).otherwise(F.lit(0.0)) + f(b + 1) - f(b))
        c = F.when(same, acc["c"]).otherwise(F.transform(acc["c"], lambda v, k: v + (k == come - 1).cast("int") - (k == go - 1).cast("int")))
        hit = (i >= w) & (F.lit(log2(w)) - s / w >= kind.bits)
        lo, hi = at + i - w, at + i
        joins = hit & (acc["hi"] >= lo)
        start = F.when(joins, acc["lo"]).when(hit, lo).otherwise(acc["lo"])
        end = F.when(hit, hi).otherwise(acc["hi"])
        out = F.when(hit & ~joins & (acc["hi"] >= 0), F.concat(acc["out"], _one(acc["lo"], acc["hi"], 3))).otherwise(acc["out"])
        return F.struct(c.alias("c"), s.alias("s"), start.cast("long").alias("lo"), end.cast("long").alias("hi"), out.alias("out"))

    done = F.aggregate(F.sequence(F.lit(1), F.length(candidate)), state, step, lambda acc: F.when(acc["hi"] >= 0, F.concat(acc["out"], _one(acc["lo"], acc["hi"], 3))).otherwise(acc["out"]))
    return done


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of high-entropy windows in candidate strings that no pattern of ``allow`` excuses."""
    none = F.array().cast(_SPAN)
    out = []
    for kind in CLASSES:
        excused = lambda x: _any([x["hit"].rlike(p) for p in allow])
        out.append(_walk(text, kind.pattern, lambda s, x, k=kind: F.when(excused(x), none).otherwise(entropy_windows(x["hit"], k, s))))
    return F.array_sort(F.array_distinct(F.concat(*out)))


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind.
    An entropy span is added only where no base span overlaps it; base spans are
    never dropped. Defined cases: a null text is empty and has no spans; rows may
    repeat and ids may be null; an empty table gives no rows; other columns are
    ignored. Plan: one scan, no shuffle; texts without a match stop at rlike.
    """
    docs = narrow(df, id_col, text_col)
    t = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__t"))
    t = t.select(id_col, base_spans(F.col("__t")).alias("__base"), entropy_spans(F.col("__t"), allow).alias("__high"))
    free = F.filter("__high", lambda h: ~F.exists("__base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    t = t.select(id_col, "__base", free.alias("__free"))
    n = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    return t.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.size("__free").cast("long").alias("n_entropy"), F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("__base", "__free"))).alias("spans"))
