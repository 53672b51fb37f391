import random
import re

import numpy as np
import pytest

from corvane.llm import simhash_dedup as S
from corvane.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest as xxh

    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxh(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_against_brute_force(make, odd_rows):
    rng = random.Random(2)
    base = ["alpha beta gamma delta epsilon zeta eta theta".split() * 12 for _ in range(1)][0]
    rows = list(odd_rows)
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    got = S.simhash_dedup(make(rows)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps, 4)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("skew", [0.5, 0.05])
def test_links_connect_all_within_radius(spark, block, skew):
    """Dense clusters, chains and skewed bits; small blocks make the buckets be cut."""
    rng = random.Random(9)
    draw = lambda: sum(1 << b for b in range(64) if rng.random() < skew)
    fps = {draw() for _ in range(150)}
    for _ in range(6):
        x = draw()
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x), S._signed(x)) for x in fps], "fp long, node long")
    edges = [(r.a, r.b) for r in S.link(df, 4, block).collect()]
    at = {S._signed(x): i for i, x in enumerate(fps)}
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(at[a]), root(at[b])
        up[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == brute_components(fps, 4)


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**11])
def test_plan_is_a_valid_pigeonhole(n):
    rng = np.random.default_rng(4)
    bits = rng.random((500, 64)) < rng.uniform(0.2, 0.8, 64)
    together = (bits.T.astype(float) @ bits.astype(float)) * n / 500
    parts = S.plan(n, together)
    assert sorted(b for p, _ in parts for b in p) == list(range(64))
    assert sum(t for _, t in parts) == S.RADIUS - len(parts) + 1
    assert all(t >= -1 for _, t in parts)


def test_plan_uses_longer_keys_for_more_rows():
    together = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    assert len(S.plan(10**11, together * 10**11)) < len(S.plan(10**4, together * 10**4))


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 101)} | {1000 + i: 1000 for i in range(1, 300)} | {5000 + i: 5000 for i in range(1, 9)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(make):
    assert S.simhash_dedup(make([])).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies(make, odd_rows):
    """Copies with few changed words are found; texts that are unlike stay apart."""
    rng = random.Random(12)
    rows, base = list(odd_rows), []
    for g in range(25):
        w = [f"t{int(rng.paretovariate(0.5)) % 4000}" for _ in range(rng.choice([80, 300, 900]))]
        base.append(" ".join(w))
        rows.append((100 + 10 * g, base[-1]))
        for k in range(1, 4):
            v = list(w)
            for _ in range(max(1, len(v) * k // 200)):
                v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
            rows.append((100 + 10 * g + k, " ".join(v)))
    got = {r.doc_id: r.component_id for r in S.near_copies(make(rows)).collect() if r.doc_id is not None}
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] >= 100}
    like = [(i, i - i % 10) for i in texts if i % 10 and jaccard(texts[i], texts[i - i % 10]) >= 0.83]
    assert len(like) > 50 and sum(got[a] == got[b] for a, b in like) >= 0.97 * len(like)
    assert all(c - c % 10 == i - i % 10 for i, c in got.items() if i >= 100)
    assert got[3] == got[4] == -8 and got[0] == got[1] == got[2] == 0


def test_wide_words_are_verified(spark):
    """Equal word fingerprints don't link nodes whose wide words differ too much."""
    rows = [(5, n, w) for n, w in enumerate([0, 1, 3, 2**40 - 1, 2**40])]
    df = spark.createDataFrame([(f, n, w) for f, n, w in rows], "fp long, node long, w long")
    from corvane.llm.components import components

    got = {r.u: r.root for r in components(S.link(df, 4, 4096, 2)).collect()}
    assert got == {1: 0, 2: 0, 4: 0}


@pytest.mark.parametrize("block", [None, 8])
def test_near_copies_against_brute_force(make, monkeypatch, block):
    """Edits of every kind around the similarity asked for: nothing goes that has no text alike, and most that have one do."""
    if block:
        monkeypatch.setattr(S, "SET_BLOCK", block)
        monkeypatch.setattr(S.exact_check, "__defaults__", (S.ALIKE, S.WORDS, block))
    rng = random.Random(5)
    word = lambda: f"t{int(rng.paretovariate(0.5)) % 4000}"
    texts = {}
    for g in range(40):
        w = [word() for _ in range(rng.choice([100, 250, 600]))]
        k = rng.uniform(0.02, 0.3)
        n = int(len(w) * k)
        swapped = list(w)
        for _ in range(max(1, n // 6)):
            swapped[rng.randrange(len(w))] = word()
        for j, v in enumerate((w, w[: len(w) - n], w + [word() for _ in range(n)], swapped)):
            texts[10 * g + j] = " ".join(v)
    if block:
        texts |= {1000 + i: texts[0] + f" x{i}" for i in range(60)}
    got = {r.doc_id: r.component_id for r in S.near_copies(make(list(texts.items()))).collect()}
    ids = sorted(texts)
    near = {(a, b): jaccard(texts[a], texts[b]) for a in ids for b in ids if a < b and (a // 10 == b // 10 or min(a, 1000) in (0, 1, 2, 3, 1000) and b >= 1000)}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), j in near.items():
        if j >= 0.8:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    assert all(root(got[i]) == root(i) for i in ids)  # no link that isn't one
    linked = [(a, b) for (a, b), j in near.items() if j >= 0.8]
    assert sum(got[a] == got[b] for a, b in linked) >= 0.8 * len(linked)
    sure = [(a, b) for (a, b), j in near.items() if j >= 0.92]
    assert sum(got[a] == got[b] for a, b in sure) >= 0.97 * len(sure)


def test_exact_links_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30):
        base = rng.integers(0, 60, (3, 25)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(25) < 0.06, rng.integers(0, 60, 25), base[rng.integers(3)]).astype(np.uint64)) for _ in range(n)]
        like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        up = list(range(n))

        def root(x, up):
            return x if up[x] == x else root(up[x], up)

        for a in range(n):
            for b in range(a):
                if like(sets[a], sets[b]) >= 0.8:
                    x, y = root(a, up), root(b, up)
                    up[max(x, y)] = min(x, y)
        mine = list(range(n))
        for a, b in S.exact_links(sets):
            assert like(sets[a], sets[b]) >= 0.8
            x, y = root(a, mine), root(b, mine)
            mine[max(x, y)] = min(x, y)
        assert [root(i, mine) for i in range(n)] == [root(i, up) for i in range(n)]
