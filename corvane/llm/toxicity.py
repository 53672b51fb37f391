"""Toxicity by nearest labelled examples.

A bounded sample of labelled rows becomes a block-max inverted index over all words
that the examples hold: postings have TF-IDF weights, and for each term and block of
examples the largest weight. The sum of those maxima bounds every cosine in a block,
so blocks are read from the highest bound down and reading stops below the k-th best
cosine: the nearest examples are exact. Their votes, weighted by distance, are
calibrated by isotonic regression on labelled rows outside the index, and the
neighbours are the evidence.

Plain TF-IDF finds texts that share rare words of no meaning, so a word's weight is
tf * idf * rf (Lan et al. 2009): idf from all documents, and a relevance factor from
the shares of the two classes' examples that hold the word. No word is dropped but
those that stand in one document only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, narrow

#: Bounds of the sample that is fitted: examples of each class in the index, rows for calibration.
EXAMPLES = 1_500
CALIBRATION = 6_000
NEIGHBOURS = 15
#: Examples that a class's share of a word is drawn to the common share by.
PRIOR = 5.0
#: Weight of the vote for the base rate, beside the neighbours' own.
BASE_VOTE = 0.25
LEAST_DF = 2
BLOCK = 64
#: Terms in more than one of this many examples keep their postings as rows over all examples.
DENSE = 16
REJECT = 0.7
_WORD = re.compile(r"[^\W_]+")
_MEMO = 300_000
_PART_BYTES = 4 << 20


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], .., hi[0] - 1, lo[1], .., hi[1] - 1, ..."""
    size = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class Terms:
    """Counts the terms of a vocabulary in whole texts; remembers what tokens hold."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.memo = vocabulary, {}

    def _known(self, token: str) -> tuple[int, ...]:
        if (ids := self.memo.get(token)) is None:
            ids = tuple(self.vocabulary[w] for w in _WORD.findall(token) if w in self.vocabulary)
            if len(token) <= 64:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[token] = ids
        return ids

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, terms, frequencies): those of text i are at edges[i]..edges[i + 1], by term."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = [self._known(x) for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        term = flat[ranges((ends - size)[at], ends[at])] if len(at) else np.zeros(0, np.int64)
        text = np.repeat(np.repeat(np.arange(len(n)), n), size[at]) if len(at) else np.zeros(0, np.int64)
        v = max(len(self.vocabulary), 1)
        cell, tf = np.unique(text * v + term, return_counts=True)
        return np.searchsorted(cell, np.arange(len(n) + 1) * v), cell % v, tf


@dataclass
class Index:
    """Block-max inverted index over example vectors; ``ids`` and ``labels`` are in the order of the examples."""

    vocabulary: dict[str, int]
    idf: np.ndarray  # a term's weight: idf, with the relevance factor
    ids: list
    labels: np.ndarray
    docs: np.ndarray = field(default=None)  # postings by term, then example
    weights: np.ndarray = field(default=None)
    cells: np.ndarray = field(default=None)  # term → where its cells begin; a cell is a term in a block
    block: np.ndarray = field(default=None)  # of each cell
    most: np.ndarray = field(default=None)  # the cell's largest weight
    edges: np.ndarray = field(default=None)  # where the cell's postings begin
    row: np.ndarray = field(default=None)  # term → its row of ``dense``, or -1
    dense: np.ndarray = field(default=None)
    raws: np.ndarray = field(default=None)  # calibration: votes → probability
    probs: np.ndarray = field(default=None)
    base: float = 0.0
    seen: dict = field(default_factory=dict)

    def vector(self, counts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of length 1 from (term, frequency) pairs in order of terms."""
        t, n = np.array([i for i, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
        return t, self.weighted(t, n)

    def weighted(self, t: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[t]
        return w / max(np.sqrt((w * w).sum()), 1e-300)

    def build(self, counts: list[tuple]) -> Index:
        """From (term, frequency) pairs in order of terms for each example."""
        edges = np.concatenate([[0], np.cumsum([len(c) for c in counts], dtype=np.int64)])
        flat = np.array([x for c in counts for x in c], np.int64).reshape(-1, 2)
        return self.build_flat(edges, flat[:, 0], flat[:, 1])

    def build_flat(self, edges: np.ndarray, t: np.ndarray, tf: np.ndarray) -> Index:
        """From terms and frequencies of all examples, those of example i at edges[i]..edges[i + 1]."""
        n, v = len(edges) - 1, len(self.idf)
        d = np.repeat(np.arange(n), np.diff(edges))
        w = (1 + np.log(tf)) * self.idf[t]
        w /= np.maximum(np.sqrt(np.bincount(d, w * w, n)), 1e-300)[d]
        order = np.lexsort((d, t))
        t, self.docs, self.weights = t[order], d[order].astype(np.int32), w[order]
        blocks = max(1, -(-n // BLOCK))
        cell, first = np.unique(t * blocks + self.docs // BLOCK, return_index=True)
        self.cells, self.block = np.searchsorted(cell, np.arange(v + 1) * blocks), cell % blocks
        self.edges = np.append(first, len(t))
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        often = np.flatnonzero(np.bincount(t, minlength=v) * DENSE > n) if n else np.zeros(0, np.int64)
        self.row = np.full(v, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n))
        held = self.row[t] >= 0
        self.dense[self.row[t[held]], self.docs[held]] = self.weights[held]
        return self

    def nearest(self, counts: tuple, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        """The ``k`` examples of highest cosine above 0, best first, ties by number; exact."""
        return self.search(*self.vector(counts), k)

    def search(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        n = len(self.ids)
        if not len(t) or not len(self.docs):
            return []
        size = self.cells[t + 1] - self.cells[t]
        cell, q = ranges(self.cells[t], self.cells[t + 1]), np.repeat(w, size)
        block = self.block[cell]
        bound = np.bincount(block, q * self.most[cell], -(-n // BLOCK))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        dense = np.flatnonzero(self.row[t] >= 0)
        rows, few = self.row[t[dense]], np.repeat(self.row[t] < 0, size)
        cell, q, block = cell[few], q[few], block[few]
        wave = np.full(len(bound), -1)
        sims, docs_ = np.zeros(0), np.zeros(0, np.int64)  # the best so far, best first
        at, step = 0, 4
        while at < len(order) and (len(sims) < k or bound[order[at]] >= sims[-1] - 1e-12):
            if at:
                step = int(np.searchsorted(-bound[order[at:]], 1e-12 - sims[-1], "right")) if len(sims) == k else 2 * step
            take = order[at : at + step]
            wave[take] = at
            these = np.flatnonzero(wave[block] == at)
            lo, hi = self.edges[cell[these]], self.edges[cell[these] + 1]
            where = ranges(lo, hi)
            total = np.bincount(self.docs[where], self.weights[where] * np.repeat(q[these], hi - lo), n).astype(float)
            if len(dense):
                for a, b in _joined(np.sort(take)):
                    total[a * BLOCK : b * BLOCK] += w[dense] @ self.dense[rows, a * BLOCK : b * BLOCK]
            found = np.flatnonzero(total > (max(sims[-1] - 1e-12, 0) if len(sims) == k else 0))
            sims, docs_ = np.concatenate([sims, total[found]]), np.concatenate([docs_, found])
            top = np.lexsort((docs_, -np.round(sims, 12)))[:k]
            sims, docs_ = sims[top], docs_[top]
            at += step
        return list(zip(docs_.tolist(), sims.tolist(), strict=True))

    def votes(self, near: list[tuple[int, float]]) -> float:
        """Share of votes for label 1, each of weight cosine^2 / (0.05 + distance), and BASE_VOTE for the base rate."""
        w = np.array([s * s / (0.05 + max(0.0, 1 - s)) for _, s in near])
        y = np.array([self.labels[d] for d, _ in near], float)
        return float(((w * y).sum() + BASE_VOTE * self.base) / (w.sum() + BASE_VOTE))

    def calibrate(self, raws: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression by pooling neighbours that fall; each pool is drawn to the base rate by one row."""
        pools: list[list[float]] = []
        order = np.lexsort((labels, raws))
        for x, y in zip(raws[order], labels[order], strict=True):
            if pools and pools[-1][3] == x:
                pools[-1][0] += y
                pools[-1][1] += 1
                pools[-1][2] += x
            else:
                pools.append([float(y), 1.0, float(x), float(x)])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                s, n, xs, last = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + xs, last]
        self.raws = np.array([p[2] / p[1] for p in pools] or [0.0])
        self.probs = np.maximum.accumulate(np.array([(p[0] + self.base) / (p[1] + 1) for p in pools] or [self.base]))

    def raw(self, t: np.ndarray, tf: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        """The votes for a text's terms and its nearest examples; copies are remembered."""
        key = (t.tobytes(), tf.tobytes()) if len(t) <= 4096 else None
        if (known := self.seen.get(key)) is None:
            near = self.search(t, self.weighted(t, tf))
            known = (self.votes(near), near[:3])
            if key:
                if len(self.seen) >= 5_000:
                    self.seen.clear()
                self.seen[key] = known
        return known

    def score(self, raw: float) -> float:
        return float(np.interp(raw, self.raws, self.probs))


def _joined(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of ascending numbers as (first, end)."""
    cuts = np.flatnonzero(np.diff(blocks) > 1) + 1
    for run in np.split(blocks, cuts):
        yield int(run[0]), int(run[-1]) + 1


def in_groups(edges: np.ndarray, t: np.ndarray, tf: np.ndarray, weight: np.ndarray, groups: int = 16, features: int = 512) -> np.ndarray:
    """A group number for each example, by a few rounds of k-means over its most frequent terms, so that like ones share blocks.

    That makes the blocks' bounds tighter; it has no part in the results.
    """
    n = len(edges) - 1
    group = np.zeros(n, np.int64)
    often = np.argsort(-np.bincount(t, minlength=len(weight)), kind="stable")[:features]
    if not n or not len(often):
        return group
    column = np.full(len(weight), -1)
    column[often] = np.arange(len(often))
    m, held = np.zeros((n, len(often)), np.float32), column[t] >= 0
    m[np.repeat(np.arange(n), np.diff(edges))[held], column[t[held]]] = ((1 + np.log(tf)) * weight[t])[held]
    m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-30)
    mean = m[:: max(1, n // groups)][:groups]
    for _ in range(5):
        group = np.argmax(m @ mean.T, axis=1)
        mean = np.stack([m[group == g].mean(0) if (group == g).any() else mean[g] for g in range(len(mean))])
    return group


def _parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about _PART_BYTES of text."""
    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // _PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of texts."""
    found: set[str] = set()
    for b in it:
        for part in _parts(b, 0):
            lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(part.column(0).cast(pa.large_string()), "")))
            for token in lists.flatten().unique().to_pylist():
                found.update(_WORD.findall(token))
    out = list(found)
    for at in range(0, len(out), 1 << 16):
        yield pa.RecordBatch.from_pydict({"w": out[at : at + (1 << 16)]})


def _frequencies(shared):
    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value)
        df, n = np.zeros(len(shared.value) + 1, np.int64), 0  # the last counts the texts
        for b in it:
            for part in _parts(b, 0):
                _, t, _ = terms.count(part.column(0))
                df[:-1] += np.bincount(t, minlength=len(df) - 1)
                n += part.num_rows
        df[-1] = n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": held, "df": df[held]})

    return frequencies


def _vectors(shared):
    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value)
        for b in it:
            for part in _parts(b, 3):
                edges, t, tf = terms.count(part.column(3))
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int64())) for x in (t, tf)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["id", "role", "label", "ids", "tf"])

    return vectors


def _raws(shared):
    def raws(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in it:
            lists = [(np.array(x, np.int64), np.array(y, np.int64)) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"label": b.column(0), "raw": pa.array([index.raw(*x)[0] for x in lists], pa.float64())})

    return raws


def held_out(id_: Column) -> Column:
    """True for identifiers that no label may be learnt from."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, calibration: int = CALIBRATION) -> Index:
    """The index, from at most 2 * ``examples`` + ``calibration`` labelled rows that are not held out.

    The sample is drawn by a hash of the identifier, so it is the same on each
    run. Rows without a label or identifier are not drawn; of an identifier's
    labels the largest counts. Terms are all words of the examples that stand in
    LEAST_DF documents or more; document frequencies are counted over all documents.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "toxicity")
    docs, labels = narrow(docs, id_col, text_col), narrow(labels, id_col, label_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    known = known.withColumn("draw", F.xxhash64("id", F.lit(11))).withColumn("role", (F.pmod("draw", F.lit(10)) < 3).cast("int"))
    # of each class at most ``examples`` rows for the index; for calibration the classes as they are
    top = lambda cond, n: known.where(cond).orderBy("draw", "id").limit(n)
    drawn = top("role = 0 and label = 1", examples).unionByName(top("role = 0 and label = 0", examples)).unionByName(top("role = 1", calibration))
    drawn = store.table(drawn.select("id", "role", "label"), "drawn")
    texts = docs.join(F.broadcast(drawn), docs[id_col] == drawn["id"]).select("id", "role", "label", F.col(text_col).alias("text"))
    texts = store.table(texts, "texts")
    kind = drawn.schema["id"].dataType.simpleString()
    words = sorted(texts.where("role = 0").select("text").mapInArrow(_words, "w string").distinct().toArrow().column(0).to_pylist())
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words) + 1, np.int64)
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    shared.destroy()
    n, common = int(df[-1]), np.flatnonzero(df[:-1] >= LEAST_DF)
    vocabulary = {words[i]: k for k, i in enumerate(common.tolist())}
    idf = np.log((1 + n) / (1 + df[common])) + 1
    del words, counted
    shared = spark.sparkContext.broadcast(vocabulary)
    vectors = store.table(texts.mapInArrow(_vectors(shared), f"id {kind}, role int, label int, ids array<long>, tf array<long>"), "vectors")
    shared.destroy()
    # few narrow rows, in arrays: examples by label, then by likeness, so that like ones share blocks
    rows = vectors.where("role = 0").orderBy("label", F.col("id").cast("string"), "ids", "tf").toArrow().combine_chunks()
    label, edges, t, tf = rows.column("label").to_numpy(), *_flat(rows)
    where = np.repeat(np.arange(len(label)), np.diff(edges))
    held = [np.bincount(t[label[where] == y], minlength=len(idf)) for y in (0, 1)]
    idf = idf * relevance(held[1], held[0], int(label.sum()), int((1 - label).sum()))
    order = np.lexsort((in_groups(edges, t, tf, idf), label))
    rows = rows.take(pa.array(order))
    label, edges, t, tf = rows.column("label").to_numpy(), *_flat(rows)
    index = Index(vocabulary, idf, rows.column("id").to_pylist(), label.astype(np.int64)).build_flat(edges, t, tf)
    del rows, t, tf, where
    size = {r["label"]: r["n"] for r in vectors.where("role = 1").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    index.base = size.get(1, 0) / sum(size.values()) if size else float(label.mean()) if len(label) else 0.0
    shared = spark.sparkContext.broadcast(index)
    check = vectors.where("role = 1").select("label", "ids", "tf").repartition(spark.sparkContext.defaultParallelism)
    check = check.mapInArrow(_raws(shared), "label int, raw double").collect()
    shared.destroy()
    index.calibrate(np.array([r["raw"] for r in check]), np.array([r["label"] for r in check]))
    return index


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, terms, frequencies) of a table with lists ids and tf."""
    size = pc.list_value_length(rows.column("ids")).to_numpy().astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)]), *(pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("ids", "tf"))


def relevance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Squared log2(2 + r), r being the share of label 1's examples with the term over that of label 0's, both drawn to the common share."""
    if not n1 or not n0:
        return np.ones(len(a))
    n = n1 + n0
    return np.log2(2 + (a + PRIOR * n1 / n) / n1 / ((b + PRIOR * n0 / n) / n0)) ** 2


def scorer(spark, index: Index):
    """A function of a text column: struct(score, evidence: array of (id, label, similarity))."""
    shared = spark.sparkContext.broadcast(index)
    kind = "struct<score:double,evidence:array<struct<id:string,label:int,similarity:double>>>"
    state: list[Terms] = []

    @F.arrow_udf(kind)
    def score(text: pa.Array) -> pa.Array:
        index = shared.value
        if not state:
            state.append(Terms(index.vocabulary))
        out = []
        for part in _parts(pa.RecordBatch.from_arrays([text], ["text"]), 0):
            edges, t, tf = state[0].count(part.column(0))
            for a, b in zip(edges.tolist(), edges.tolist()[1:], strict=False):
                raw, near = index.raw(t[a:b], tf[a:b])
                out.append({"score": index.score(raw), "evidence": [{"id": str(index.ids[d]), "label": int(index.labels[d]), "similarity": s} for d, s in near]})
        t = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("similarity", pa.float64())])))])
        return pa.array(out, t)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **bounds: int) -> DataFrame:
    """One row per input row: id, ``carry``, held_out, score, predicted, evidence.

    score is the calibrated probability of label 1 from the text alone; predicted
    is 1 at REJECT or more. Defined cases: null and empty texts, and texts without
    a word of the examples, have no neighbours and score what calibration gives
    for the base rate; without labels every score is 0; ids may be null (never
    held out) or repeat; an empty table gives no rows; other columns are ignored.
    """
    t = narrow(docs, *dict.fromkeys((id_col, text_col, *carry)))
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col, **bounds))
    extra = [c for c in dict.fromkeys(carry) if c != id_col]
    t = t.withColumn("__s", score(F.col(text_col)))
    return t.select(id_col, *extra, held_out(F.col(id_col)).alias("held_out"), F.col("__s.score").alias("score"), (F.col("__s.score") >= REJECT).cast("int").alias("predicted"), F.col("__s.evidence").alias("evidence"))
