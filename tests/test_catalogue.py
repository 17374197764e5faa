"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from ledgerloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, name):
    """Queries that SQL can't say: small tests hold their results; here, that whole tables pass and that a run repeats."""
    rows = [_rows((df := catalogue.queries()[name](spark, DIR)).columns, df.collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0][1]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
