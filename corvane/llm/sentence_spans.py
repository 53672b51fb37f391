"""Substring duplicates as spans of consecutive sentences.

A sentence here ends at . ! ? or a line end, and also after a word that a hash of it
and the word before it in the sentence picks, one in CUT. The last kind of end depends
on two words only, so a passage pasted into the middle of foreign text falls into the
same sentences there as elsewhere but for its edges, and text without stops is cut too.

A span is a run of at least SENTENCES sentences and LEAST_WORDS words. Taken are the
shortest span from each sentence on and the shortest span back from each sentence
that ends with a stop or a line, so a passage is covered from its first sentence to
the last one that ends so, and but for a few words beyond. Spans are hashed and joined over the
whole corpus; of equal spans the one in the row with the smallest (identifier, text
hash), and there the first, is the first. Sentences that a non-first span covers are
removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, narrow

SENTENCES = 3
#: A passage of 50 words keeps this many within whole sentences, as an edge seldom costs more than two sentences of four words.
LEAST_WORDS = 32
CUT = 5
STOPS = ".!?"
_LINE = "\x01"  # stands for a line end behind the word before it
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MEMO = 300_000
_PART_BYTES = 4 << 20
# Odd multipliers for the two halves of the hash, and their inverses modulo 2^64.
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class Cut:
    """The sentences of several texts, one after the other."""

    hashes: np.ndarray  # of each word
    edges: np.ndarray  # words before each sentence, and all
    texts: np.ndarray  # sentences before each text, and all
    stops: np.ndarray  # whether a sentence ends with a stop, a line or its text


class Cutter:
    """Cuts texts into sentences; remembers the hash of words and whether a sentence ends with them."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, bool]] = {}

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_64_intdigest as digest

        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        got = []
        for w in words:
            if (known := memo.get(w)) is None:
                bare = w.rstrip(_LINE)
                known = (digest(bare), bare != w or bare[-1:] in STOPS)
                if len(w) <= 64:
                    memo[w] = known
            got.append(known)
        return np.array([h for h, _ in got], np.uint64), np.array([e for _, e in got], bool)

    def cut(self, texts: pa.Array) -> Cut:
        marked = pc.replace_substring_regex(pc.ascii_trim_whitespace(texts), r"[\t-\r ]*\n[\t-\r ]*", _LINE + " ")
        lists = pc.ascii_split_whitespace(marked.cast(pa.large_string()))
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        size[pc.equal(pc.binary_length(marked), 0).to_numpy(zero_copy_only=False)] = 0  # an empty text is not one empty word
        words = words.filter(pc.not_equal(pc.binary_length(words), 0)).dictionary_encode()
        h, stop = self._words(words.dictionary.to_pylist())
        at = words.indices.to_numpy(zero_copy_only=False)
        h, end = (h[at], stop[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, bool))
        first = np.concatenate([[0], np.cumsum(size)])
        end[first[1:][size > 0] - 1] = True
        stop = end.copy()
        if len(h) > 1:
            with np.errstate(over="ignore"):
                picked = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(CUT) == 0
            end[1:] |= picked & ~stop[:-1]
        edges = np.concatenate([[0], np.flatnonzero(end) + 1])
        return Cut(h, edges, np.searchsorted(edges, first), stop[edges[1:] - 1])


def runs(c: Cut, count: int = SENTENCES, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, end) of the shortest spans from each sentence on and, where they are others, back from each that ``stops``; by first, then end."""
    n = len(c.edges) - 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(c.texts, np.arange(n), "right") - 1
    i = np.arange(n)
    on = np.maximum(np.searchsorted(c.edges, c.edges[:-1] + least), i + count)
    fits = on <= c.texts[text + 1]
    end = np.arange(1, n + 1)
    back = np.minimum(np.searchsorted(c.edges, c.edges[1:] - least, "right") - 1, end - count)
    other = c.stops & (back >= c.texts[text])
    other &= np.where(other, on[np.maximum(back, 0)] != end, False)
    first, stop = np.concatenate([i[fits], back[other]]), np.concatenate([on[fits], end[other]])
    order = np.lexsort((stop, first))
    return first[order], stop[order]


def run_hashes(c: Cut, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each run's words: polynomials in two odd bases, from prefix sums."""
    a, b = c.edges[first], c.edges[stop]
    out = []
    with np.errstate(over="ignore"):
        for k, (base, inverse) in enumerate(_BASES):
            power, undo = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c.hashes), x, np.uint64)])) for x in (base, inverse))
            h = _mixed(c.hashes + np.uint64(k * 0x2545F4914F6CDD1D))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
            out.append(_mixed((sums[b] - sums[a]) * undo[a] + (b - a).astype(np.uint64)).view(np.int64))
    return out[0], (out[1] >> 32).astype(np.int32)


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about _PART_BYTES of text."""
    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // _PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def _spans(count: int, least: int):
    def spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for b in it:
            for part in _parts(b, 2):
                c = cutter.cut(part.column(2))
                first, stop = runs(c, count, least)
                h0, h1 = run_hashes(c, first, stop)
                row = np.searchsorted(c.texts, first, "right") - 1
                with np.errstate(over="ignore"):
                    mark = h0.view(np.uint64) ^ _mixed(h1.view(np.uint32) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                again = np.ones(len(row), bool)
                again[np.unique(mark, return_index=True)[1]] = False  # the first of its kind in its text
                for at in range(0, len(row), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    take = pa.array(row[s])
                    rest = {"h0": h0[s], "h1": h1[s], "first": (first[s] - c.texts[row[s]]).astype(np.int32), "n": (stop[s] - first[s]).astype(np.int32), "again": again[s]}
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *map(pa.array, rest.values())], ["id", "key", *rest])

    return spans


REMOVED = "struct<text:string,n_sentences:int,n_removed:int,removed:array<struct<start:int,end:int>>>"


def cut_out(text: str, edges: np.ndarray, gone: np.ndarray) -> tuple[str, list[dict]]:
    """``text`` without the sentences where ``gone`` is true, and the ranges of code points removed (end exclusive)."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, removed, at = [], [], 0
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
        lo, hi = starts[edges[a]], starts[edges[b]]
        kept.append(text[at:lo])
        removed.append({"start": lo, "end": hi})
        at = hi
    return "".join(kept) + text[at:], removed


def without(text: pa.Array, firsts: pa.Array, sizes: pa.Array) -> pa.Array:
    """``text`` without the sentences of the spans, their number and that of all sentences, and what was removed."""
    c = Cutter().cut(text := pc.fill_null(text, ""))
    n = np.diff(c.texts)
    counts, removed, hit, left = np.zeros(len(text), np.int32), [[] for _ in range(len(text))], np.zeros(len(text), bool), []
    for k in np.flatnonzero(pc.fill_null(pc.list_value_length(firsts), 0).to_numpy(zero_copy_only=False)):
        a = firsts[k].values.to_numpy(zero_copy_only=False)
        steps = np.zeros(n[k] + 1, np.int64)
        np.add.at(steps, a, 1)
        np.add.at(steps, a + sizes[k].values.to_numpy(zero_copy_only=False), -1)
        gone = np.cumsum(steps[:-1]) > 0
        edges = c.edges[c.texts[k] : c.texts[k + 1] + 1]
        less, removed[k] = cut_out(text[k].as_py(), edges - edges[0], gone)
        counts[k], hit[k] = gone.sum(), True
        left.append(less)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    rest = pc.replace_with_mask(text, pa.array(hit), pa.array(left, text.type))
    return pa.StructArray.from_arrays([rest, pa.array(n.astype(np.int32)), pa.array(counts), pa.array(removed, pa.list_(span))], ["text", "n_sentences", "n_removed", "removed"])


def span_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), count: int = SENTENCES, least: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: id, ``carry``, n_sentences, n_removed, has_repeat, removed, text (what is left).

    Defined cases: null and empty texts have no sentences and stay empty; a null
    identifier comes last in the order of first occurrence; rows equal in id and
    text share one fate, and the spans of such a row are first if it is; a span
    that repeats within its own document is removed there too; identifiers may be
    of any type that has an order; an empty table gives no rows; other columns are
    ignored.

    Plan: spans carry no text. Equal ones are counted with pre-aggregation, and
    repeated hashes are joined back, where a hot hash can be split; all later steps
    have the repeated spans only. A repeat within one text is seen where the text is
    cut. In the end texts meet the list of their own spans in one shuffle.
    """
    docs = narrow(df, *dict.fromkeys((id_col, text_col, *carry)))
    extra = [c for c in dict.fromkeys(carry) if c not in (id_col, text_col)]
    text = F.coalesce(text_col, F.lit(""))
    t = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    spans = t.mapInArrow(_spans(count, least), f"id {kind}, key long, h0 long, h1 int, first int, n int, again boolean")
    # tables are written, as adaptive execution splits a hot hash only where a join reads both sides from shuffles of its own
    store = Scratch(df.sparkSession, "spans")
    on = (F.col("h0") == F.col("__h0")) & (F.col("h1") == F.col("__h1"))
    often = store.table(spans.groupBy(F.col("h0").alias("__h0"), F.col("h1").alias("__h1")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("__h0", "__h1"), "often")
    spans = store.table(spans.join(often, on).drop("__h0", "__h1"), "repeated")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    owner = spans.groupBy(F.col("h0").alias("__h0"), F.col("h1").alias("__h1")).agg(F.min(rank).alias("o"))
    owner = store.table(owner.select("__h0", "__h1", F.col("o.id").alias("__o"), F.col("o.key").alias("__k")), "owners")
    late = spans.join(owner, on).where(F.col("again") | ~(F.col("id").eqNullSafe(F.col("__o")) & (F.col("key") == F.col("__k"))))
    late = late.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("first", "n")).alias("__runs"))
    rows = docs.withColumn("__mine", F.xxhash64(text))
    rows = rows.join(late, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mine") == F.col("__key")), "left")
    rows = rows.withColumn("__w", F.arrow_udf(without, REMOVED)(F.col(text_col), F.col("__runs.first"), F.col("__runs.n")))
    n = F.col("__w.n_removed")
    return rows.select(id_col, *extra, F.col("__w.n_sentences").alias("n_sentences"), n.alias("n_removed"), (n > 0).alias("has_repeat"), F.col("__w.removed").alias("removed"), F.col("__w.text").alias(text_col))
