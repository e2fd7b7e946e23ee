"""Every query against its oracle on the smallest tables."""

import os

import duckdb
import pytest

from weirgate.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return db


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr(r[i]) for i in order] for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_its_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    wanted = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(wanted.fetchall(), columns)
