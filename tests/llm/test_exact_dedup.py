import hashlib
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.exact_dedup import PatriciaTrie, exact_dedup

WS = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    g = defaultdict(list)
    for r in rows:
        g[WS.sub(" ", r[1] or "")].append(r[0])
    out = []
    for k, ids in g.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(k.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force(spark, make, odd_rows):
    got = [tuple(r) for r in exact_dedup(make(odd_rows)).collect()]
    assert sorted(got, key=str) == brute(odd_rows)


def test_empty_table(make):
    assert exact_dedup(make([])).count() == 0


def test_carries_columns(make, odd_rows):
    t = exact_dedup(make(odd_rows), carry=("text", "source"))
    assert t.columns == ["doc_id", "text", "source", "keep_id", "group_size", "kept", "text_sha256"]
    assert t.count() == len(odd_rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6).map(str.encode), st.integers(0, 99)), max_size=60))
def test_trie_is_a_dictionary(items):
    trie, want = PatriciaTrie(), {}
    for k, i in items:
        trie.insert(k, i)
        best, n = want.get(k, (i, 0))
        want[k] = (min(best, i), n + 1)
    assert {k: (b, n) for k, b, n in trie.items()} == want


def test_trie_spills_subtrees(tmp_path):
    rng = random.Random(1)
    keys = [(b"shared prefix " * 3 + bytes(rng.choices(b"abc", k=rng.randint(0, 40)))) for _ in range(3000)]
    trie, want = PatriciaTrie(limit=20_000, folder=str(tmp_path)), {}
    for i, k in enumerate(keys):
        trie.insert(k, i)
        want.setdefault(k, [i, 0])[1] += 1
    assert trie.files
    got = list(trie.items())
    assert {k: [b, n] for k, b, n in got} == want and len(got) == len(want)
    assert not list(tmp_path.iterdir())


def test_spill_above_an_earlier_one(tmp_path):
    """Later keys leave the prefix that all keys up to the first spill share, so a spill takes a subtree with a stub."""
    rng = random.Random(2)
    draw = lambda head, n: [head + bytes(rng.choices(b"abc", k=30)) for _ in range(n)]
    early = draw(b"header ", 300)
    keys = early + draw(b"other ", 20) + draw(b"header ", 300) + early + draw(b"he", 100) + early
    trie, want, nested = PatriciaTrie(limit=20_000, folder=str(tmp_path)), {}, False
    for i, k in enumerate(keys):
        trie.insert(k, i)
        want.setdefault(k, [i, 0])[1] += 1
        nested = nested or any(trie.files.values())
    assert nested
    got = list(trie.items())
    assert len(got) == len(want) and {k: [b, n] for k, b, n in got} == want
    assert not list(tmp_path.iterdir())


def test_hot_group(make):
    rows = [(i, "copy") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(200)]
    t = exact_dedup(make(rows)).collect()
    assert sum(r.kept for r in t) == 201 and max(r.group_size for r in t) == 400
