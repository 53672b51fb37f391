import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import toxicity as X

BAD = ["vile", "scoundrel", "wretch", "rotter"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_quality_and_columns(spark, make):
    rows, labels = corpus(900)
    got = X.toxicity(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 900
    y = dict(labels)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in got if r.held_out]
    hit = sum(r.predicted == y[r.doc_id] for r in out)
    assert hit / len(out) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, make):
    rows, labels = corpus(400)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in X.toxicity(make(rows), spark.createDataFrame(v, "doc_id long, toxic int")).collect()) for v in (labels, flipped))
    assert a == b


def test_edges(spark, make, odd_rows):
    rows, labels = corpus(300)
    bad = spark.createDataFrame([*labels, (None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    got = X.toxicity(make([*odd_rows, *[(1000 + i, t) for i, t in rows]]), bad).collect()
    assert len(got) == len(odd_rows) + 300 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.toxicity(make(odd_rows), none).collect()} == {0.0}
    assert X.toxicity(make([]), none).count() == 0


def brute_nearest(index, rows, counts, k):
    t, w = index.vector(counts)
    q = dict(zip(t.tolist(), w.tolist(), strict=True))
    sims = []
    for d, c in enumerate(rows):
        tt, ww = index.vector(c)
        s = sum(q.get(a, 0.0) * b for a, b in zip(tt.tolist(), ww.tolist(), strict=True))
        if s > 0:
            sims.append((-round(s, 9), d))
    return sorted(sims)[:k]


@pytest.mark.parametrize("n", [1, 50, 700])
def test_block_max_search_is_exact(n):
    rng = random.Random(n)
    v = 60
    draw = lambda: tuple(sorted(Counter(min(int(rng.paretovariate(0.7)) - 1, v - 1) for _ in range(rng.randint(1, 9))).items()))
    rows = sorted(draw() for _ in range(n))
    index = X.Index({str(i): i for i in range(v)}, np.array([1 + math.log(1 + i) for i in range(v)]), list(range(n)), np.array([i % 2 for i in range(n)])).build(rows)
    for _ in range(40):
        q = draw()
        got = [(-round(s, 9), d) for d, s in index.nearest(q, 7)]
        want = brute_nearest(index, rows, q, 7)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-8)
        assert [d for _, d in got] == [d for _, d in want]
    assert index.nearest((), 7) == []


def test_calibration_rises():
    rng = np.random.default_rng(1)
    raw = rng.random(2000)
    y = (rng.random(2000) < raw**2).astype(int)
    index = X.Index({}, np.zeros(0), [], np.zeros(0))
    index.base = float(y.mean())
    index.calibrate(raw, y)
    x = np.linspace(0, 1, 50)
    p = np.interp(x, index.raws, index.probs)
    assert (np.diff(p) >= -1e-12).all() and np.abs(p - x**2).mean() < 0.05
