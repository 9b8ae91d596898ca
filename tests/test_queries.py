"""Every query against its SQL on the smallest tables; without SQL: it runs and its schema holds."""

import math

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def names():
    from evalsift.plans import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from evalsift.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        have = [d[0] for d in cur.description]
        assert sorted(have) == cols
        assert got == sorted(tuple(norm(dict(zip(have, r, strict=True))[c]) for c in cols) for r in cur.fetchall())


def test_entry_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert "ngram_overlap" in q and set(o) <= set(q)
