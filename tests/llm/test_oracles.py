"""Queries that SQL can express give the rows that DuckDB gives for their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm.chat_quotes import quote_threads
from quillon.llm.queries import ORACLES, QUERIES

from ..conftest import DATA
from ..test_queries import rows_of

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_threads_of_a_fixture_with_quotes_and_gaps(spark):
    rnd = random.Random(6)
    told = ["one line", "Another  line", "third", "a > b", "x", ""]
    rows = []
    for conv in range(60):
        for turn in sorted(rnd.sample(range(40), rnd.randint(1, 15))):
            lines = [">" * rnd.choice([0, 0, 1, 1, 2]) + rnd.choice(["", " "]) + rnd.choice(told) for _ in range(rnd.randint(0, 5))]
            rows.append((conv, turn, rnd.choice(["user", "bot"]), rnd.choice(["\n", "\r\n"]).join(lines)))
    rows += [(999, 7 * k, "user", "w" * 200_000 if k == 3 else "y") for k in range(400)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("before", F.lit(1)).withColumn("part", F.lit(2))
    duck = duckdb.connect()
    arrow = docs.toArrow()  # noqa: F841  read by the view
    duck.execute("create table conversations as select * from arrow")
    got, want = quote_threads(docs.repartition(7)), duck.execute(ORACLES["op2_quote_threads"])
    columns = [d[0] for d in want.description]
    found = got.collect()
    assert rows_of(got.columns, found) == rows_of(columns, want.fetchall())
    assert len({r.parent_turn for r in found if r.n_linked}) > 5 and len({r.thread_turn for r in found if r.conv_id == 999}) == 1
