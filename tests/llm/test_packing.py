import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.packing import SHARD_PIECES, SIZES, best_fit, pack
from corvane.llm.token_counts import token_counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]))
def test_bins_hold_their_contents(lengths, sizes):
    lengths.sort(reverse=True)
    places, caps = pack(lengths, sizes, 2)
    used = [[] for _ in caps]
    for (b, o), n in zip(places, lengths, strict=True):
        used[b].append((o, n))
    for rows, cap in zip(used, caps, strict=True):
        rows.sort()
        assert all(o == sum(n for _, n in rows[:k]) for k, (o, _) in enumerate(rows))
        total = sum(n for _, n in rows)
        assert total <= cap and cap == min(c for c in sizes if c >= total)  # downsized


def test_best_fit_places_each_in_the_fullest_bin_with_room():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    places, _ = pack(lengths, (64,), 0)
    used = []
    for (b, _), n in zip(places, lengths, strict=True):
        fits = [64 - u for u in used if 64 - u >= n]
        if fits:
            assert 64 - used[b] == min(fits)
            used[b] += n
        else:
            assert b == len(used)
            used.append(n)


def test_sizes_chosen_jointly():
    assert sorted(pack([100] * 3, (128, 1024), 16)[1]) == [128, 128, 128]
    places, caps = pack([100] * 40, (128, 1024), 200)
    assert caps.count(1024) == 4 and len({b for b, _ in places}) == 4


def test_pieces_cover_documents(make, odd_rows):
    got = best_fit(make(odd_rows)).collect()
    n = {}
    for r in got:
        n.setdefault(r.doc_id, []).append((r.start, r.length))
    want = {}
    for i, t, *_ in odd_rows:
        want[i] = want.get(i, 0) + len((t or "").split()) + 1
    assert {i: sum(x for _, x in v) for i, v in n.items()} == want
    assert sorted(n[5]) == [(a, min(4096, 60_001 - a)) for a in range(0, 60_001, 4096)]
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for rows in bins.values():
        assert len({r.capacity for r in rows}) == 1 and rows[0].capacity in SIZES
        assert sum(r.length for r in rows) <= rows[0].capacity


def test_fill_on_data(spark, sf_dir):
    got = best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    caps = {(r.shard, r.bin): r.capacity for r in got}
    assert sum(r.length for r in got) / sum(caps.values()) > 0.95


@pytest.mark.parametrize("rows", [[], [(1, "")]])
def test_edge_tables(make, rows):
    assert best_fit(make(rows)).count() == len(rows)


def test_a_mass_of_equal_rows_is_spread(spark):
    n = 40_000
    got = best_fit(spark.range(n).selectExpr("cast(null as long) as doc_id", "'a b c' as text")).collect()
    assert len(got) == n and all((r.start, r.length) == (0, 4) for r in got)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(sizes) >= n // SHARD_PIECES and max(sizes.values()) < 2 * SHARD_PIECES
    assert len({(r.shard, r.bin, r.offset) for r in got}) == n


def test_lengths_by_name(make, odd_rows):
    counts = token_counts(make(odd_rows))
    got = best_fit(counts, length="n_tokens").collect()
    assert sum(r.length for r in got) == sum(r.n_tokens + 1 for r in counts.collect())
    assert best_fit(counts.limit(0), length="n_tokens").count() == 0
    low = counts.selectExpr("doc_id", "if(n_tokens % 2 = 0, null, -5) as n_tokens")
    assert [r.length for r in best_fit(low, length="n_tokens").collect()] == [1] * len(odd_rows)
