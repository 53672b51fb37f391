import re

import corpus_pipeline as P
from corvane.llm import queries
from corvane.llm.common import DOCUMENT

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_their_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    kept = docs
    sizes = []
    for name, stage in P.STAGES[:3]:
        kept = stage(spark, kept, sf_dir).cache()
        assert tuple(kept.columns) == DOCUMENT
        rows = kept.collect()
        assert all(tuple(r) == tuple(before[r.doc_id]) for r in rows), name  # unchanged rows
        assert len({r.doc_id for r in rows}) == len(rows)
        sizes.append(len(rows))
    assert 0 < sizes[2] <= sizes[1] <= sizes[0] <= len(before)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in rows]
    assert len(set(norm)) == len(norm)
    mixed = P.STAGES[3][1](spark, kept, sf_dir).cache()
    assert tuple(mixed.columns) == DOCUMENT
    rows = mixed.collect()
    assert all(r.n_chars == len(r.text) and WORD.search(r.text) for r in rows)
    packed = P.STAGES[4][1](spark, mixed, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(len(WORD.findall(r.text)) + 1 for r in rows)
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_run_gives_the_same(spark, sf_dir):
    a, b = P.run(spark, sf_dir), P.run(spark, sf_dir)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_exact_and_near_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    got = P.drop_exact_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in rows if i in set(first.values()))}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = {r.doc_id for r in P.drop_near_copies(spark, got, sf_dir).collect()}
    for i in sets:
        if i not in kept:
            assert max(like(i, j) for j in sets if j != i) >= 0.6  # nothing unlike goes
        elif any(j < i and like(i, j) >= 0.9 for j in sets):
            raise AssertionError(f"{i} should have gone")


def test_all_queries_are_there():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
