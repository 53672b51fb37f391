import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def shown(rows):
    return sorted(str([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_and_its_sql(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    r = db.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(got.columns)
    assert shown(tuple(x) for x in got.select(*[f"`{c}`" for c in cols]).collect()) == shown(r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
