"""Every registered query against DuckDB."""

import duckdb
import pytest

from inkveil.plans import queries

#: Queries that SQL cannot express; their own tests hold them against brute force.
ALONE = {"near_copies"}
NAMES = sorted(set(queries.queries()) - ALONE)

@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    got = queries.queries()[name](spark, sf).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)
    plain = lambda f: f.astype(str).replace({"None": "~", "nan": "~", "NaT": "~", "<NA>": "~"}).sort_values(order).reset_index(drop=True)
    assert plain(got).equals(plain(want))


def test_every_query_has_an_answer():
    assert set(queries.oracle_sql()) == set(NAMES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
