import duckdb
import pytest

from corvane.llm import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf_dir, db, name):
    got = queries.QUERIES[name](spark, sf_dir)
    r = db.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(got.columns)
    show = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in row]) for row in rows)
    assert show(tuple(x) for x in got.select(*cols).collect()) == show(r.fetchall())
