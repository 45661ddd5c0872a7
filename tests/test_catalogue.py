"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from tideline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.oracle_sql()[name]}) q")
    assert sorted(duck.sql(catalogue.oracle_sql()[name]).columns) == columns
    assert plain(df.select(*columns).collect()) == plain(expected.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_head_of_line_prunes_before_its_window(spark, sf):
    from tideline.operators import claim
    from tideline.sources import tables

    plan = claim.eligible(tables.deliveries(spark, sf), tables.now())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
