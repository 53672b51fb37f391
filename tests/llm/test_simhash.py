import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm.simhash import block_tables, count_near, edit_fingerprints, search


def follow(rows):
    """Each row with its successor's text, by id (nulls last), then text."""
    r = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return [(i, t, r[(k + 1) % len(r)][1]) for k, (i, t) in enumerate(r)]


def test_edited_texts(make, odd_rows):
    got = edit_fingerprints(make(odd_rows)).collect()
    want = []
    for i, t, nxt in follow(odd_rows):
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 32 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[0] == by[1] == by[2] == {"0" * 32}  # no words
    assert by[4] == by[None]  # equal texts


def brute_fingerprint(text):
    """Votes counted one by one, with the engine's own hash function from the xxhash package."""
    from xxhash import xxh64_intdigest as xxh

    w = (text or "").lower().split()
    if not w:
        return 0
    terms = [" ".join(w[i : i + 2]) for i in range(len(w))]
    weight = lambda t: 1 if len(t) <= 6 else 2 if len(t) <= 10 else 3 if len(t) <= 15 else 4
    total, out = sum(map(weight, terms)), 0
    for b in range(64):
        if 2 * sum(weight(t) for t in terms if xxh(t.encode(), 42) >> b & 1) > total:
            out |= 1 << b
    return out


def test_first_half_against_brute_force(make):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "be", "gammas", "de", "epsilonics"], k=rng.randint(0, 40)))) for i in range(30)]
    got = {r.doc_id: int(r.fingerprint[:16], 16) for r in edit_fingerprints(make(rows)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in rows}


def test_many_buckets(make, monkeypatch):
    from corvane.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    rows = [(rng.randint(-40, 400), f"text {i} of {i % 5}") for i in range(150)]
    got = edit_fingerprints(make(rows)).collect()
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for i, t, n in follow(rows)]
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == sorted(want)


def test_half_edited_texts_are_nearer_than_neighbours(spark, sf_dir):
    got = edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def test_edge_tables(make):
    assert edit_fingerprints(make([])).count() == 0
    one = edit_fingerprints(make([(3, "a b c d")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 5), (6, 8)])
def test_search_finds_all(spark, radius, blocks):
    rng = random.Random(radius)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(128) for _ in range(12)]
    rows = []
    for i in range(240):
        x = base[i % 12]
        for b in rng.sample(range(128), rng.randint(0, 9)):
            x ^= 1 << b
        rows.append((i, x))
    df = spark.createDataFrame([(i, sign(x & (1 << 64) - 1), sign(x >> 64)) for i, x in rows], "id long, f0 long, f1 long")
    got = sorted((r.query_id, r.id, r.distance) for r in search(df.where("id % 5 = 0"), df, radius, blocks).collect())
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in rows if i % 5 == 0 for j, y in rows if (x ^ y).bit_count() <= radius)
    assert got == want
    assert len(block_tables(radius, blocks)) >= 1


def test_counts_of_near_rows(spark, make):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(120):
        w = list(base) if i % 3 else [f"v{rng.randrange(900)}" for _ in range(200)]
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    t = edit_fingerprints(make([*rows, (None, "w1"), (50, "w1 w2")]), halves=True).cache()
    got = count_near(t, F.col("doc_id") % 5 == 0, 3, 5).collect()
    mask = (1 << 64) - 1
    fps = [(r.f0 & mask) << 64 | r.f1 & mask for r in got]
    assert len(got) == 122
    for r, f in zip(got, fps, strict=True):
        want = sum((f ^ g).bit_count() <= 3 for g in fps) - 1
        assert r.n_near == (want if r.doc_id is not None and r.doc_id % 5 == 0 else None)
