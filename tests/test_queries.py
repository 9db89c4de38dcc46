"""Every query with an oracle gives the rows that DuckDB gives for its SQL."""

import duckdb
import pytest

from quillon.queries import ORACLES, QUERIES, TABLES

from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return own


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_generated_sizes(spark):
    sizes = {"gen_users": 5_000_000, "gen_orders": 20_000_000, "gen_skewed_orders": 20_000_000}
    assert {name: QUERIES[name](spark, SF).count() for name in sizes} == sizes
    # 5,000,000 users, 5 % of them with half of the orders
    made = QUERIES["gen_orders"](spark, SF).selectExpr("max(user_id) as top", "avg(int(user_id <= 250000)) as heavy").first()
    assert 4_990_000 < made.top <= 5_000_000 and abs(made.heavy - 0.5) < 0.01
