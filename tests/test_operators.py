"""Semantics that the query suite's tables don't reach: nulls, empties, duplicates, negatives, clashes."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillon import Catalog, Engine
from quillon.operators.joins import STRATEGIES, hot_keys, join, salted
from quillon.operators.summaries import above, group_summary, summarize
from quillon.plans.report import explain_text, metrics, operators, scans
from quillon.sources.catalog import UnknownTable
from quillon.sources.generated import orders, skewed_orders, users
from quillon.sources.parquet import bounds, scan, skipping, write_sorted
from quillon.streaming.windows import stream, tumbling_counts

from .conftest import DATA

SF = f"{DATA}/sf0.001"
NAMES = ["customer", "orders", "lineitem", "events"]


@pytest.fixture
def catalog(spark):
    return Catalog.of_folder(spark, SF, NAMES)


def bag(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_catalog(catalog):
    assert catalog.columns("CUSTOMER")[0] == "c_custkey"
    assert catalog.first_numeric_column("orders") == "o_orderkey"
    with pytest.raises(UnknownTable, match="customer"):
        catalog.path("nothing")


def test_sql_is_resolved_at_once(catalog):
    engine = Engine(catalog)
    with pytest.raises(AnalysisException):
        engine.sql("select no_such_column from customer")
    assert engine.sql("select c_custkey as k from customer order by 1 limit 3").columns == ["k"]
    assert "Scan" in engine.explain("select c_name from customer") or "Relation" in engine.explain("select c_name from customer")
    assert sum(b.num_rows for b in engine.batches("select c_name from customer", 40)) == catalog.table("customer").count()
    assert list(engine.batches("select c_name from customer where c_custkey < -1")) == []


def test_engines_keep_to_their_catalogs(spark):
    small, large = (Engine(Catalog.of_folder(spark, f"{DATA}/{sf}", NAMES)) for sf in ("sf0.001", "sf0.01"))
    spark.range(3).createOrReplaceTempView("orders")
    count = "select count(*) from customer"
    first = small.sql(count)
    assert [e.sql(count).first()[0] for e in (small, large, small)] == [150, 1500, 150] and first.first()[0] == 150
    assert large.sql("select count(*) from orders").first()[0] == 15000
    assert spark.table("orders").count() == 3 and not spark.catalog.tableExists("customer")
    spark.catalog.dropTempView("orders")


def test_batches_are_columns(spark, catalog):
    engine = Engine(catalog)
    rows = catalog.table("lineitem").repartition(5)
    got = list(engine.batches(rows, 700))
    assert [b.num_rows for b in got] == [700] * 8 + [400]
    assert got[0].schema.names == rows.columns
    odd = spark.sql("select cast(null as int) as n, array(1, null) as a, map('k', 1.5D) as m, timestamp_ntz'2024-01-02 03:04:05' as t")
    (one,) = engine.batches(odd)
    assert one.to_pylist()[0]["a"] == [1, None] and one.to_pylist()[0]["t"].hour == 3


def test_scan_pushes_down(spark, catalog):
    rows = scan(spark, catalog.path("customer"), ["c_name"], above=("c_acctbal", 9000.5))
    (text,) = scans(rows)
    assert "GreaterThan(c_acctbal,9000.5)" in text and "ReadSchema: struct<c_name:string,c_acctbal:double>" in text
    assert "c_mktsegment" not in explain_text(rows).split("ReadSchema")[1]


def test_sorted_copy_skips(spark, catalog, tmp_path):
    path = str(tmp_path / "sorted")
    write_sorted(catalog.table("lineitem"), "l_orderkey", path, 8)
    top = catalog.table("lineitem").agg(F.max("l_orderkey")).first()[0]
    found = skipping(spark, path, "l_orderkey", top * 0.95)
    assert found.read < 8 and found.skipped > 0 and found.read + found.skipped == 8
    assert skipping(spark, path, "l_quantity", 49).skipped == 0
    assert skipping(spark, path, "l_returnflag", "R").skipped == 8 and skipping(spark, path, "l_returnflag", "A").skipped == 0
    assert skipping(spark, path, "l_shipdate", datetime(2100, 1, 1)).read == 0
    assert skipping(spark, path, "l_shipdate", datetime(1900, 1, 1)).skipped == 0
    assert len(bounds(spark, path).collect()) == 11
    odd = str(tmp_path / "odd")
    spark.sql("select cast(null as string) as s, cast(id as decimal(9,2)) as d, date_add(date'2024-01-01', cast(id as int)) as t from range(5)").coalesce(1).write.parquet(odd)
    assert skipping(spark, odd, "s", "a").skipped == 1
    assert [skipping(spark, odd, "d", Decimal(x)).skipped for x in ("3.99", "4")] == [0, 1]
    assert [skipping(spark, odd, "t", date(2024, 1, x)).skipped for x in (4, 5)] == [0, 1]
    with pytest.raises(AnalysisException):
        write_sorted(catalog.table("lineitem"), "l_orderkey", path, 8)


def test_metrics(catalog):
    counted = metrics(above(catalog.table("customer"), "c_acctbal", 9000.5).groupBy("c_mktsegment").count())
    assert any("numFiles" in own for _, own in counted)


NULLS = "g string, v int"


def test_summaries_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 3), ("b", None)], NULLS)
    assert bag(group_summary(rows, "g", "v")) == sorted([("a", 1, 1, 1.0), (None, 1, 3, 3.0), ("b", 0, None, None)], key=repr)
    assert tuple(summarize(rows, "v").first()) == (4, 4, 2.0, 1, 3)
    assert tuple(summarize(rows.where("false"), "v").first()) == (0, 0, None, None, None)
    assert group_summary(rows.where("false"), "g", "v").count() == 0


def test_nan_is_above_unless_dropped(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert above(rows, "v", 0).count() == 2
    assert above(rows, "v", 0, nan=False).count() == 1


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_join_semantics(spark, strategy):
    probe = spark.createDataFrame([(1, "a"), (-1, "b"), (None, "c"), (5, "d"), (7, "e")], "k long, v string")
    build = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (-1, "z"), (None, "n"), (9, "w")], "k long, v string")
    got = join(probe, build, "k", "k", strategy, n=3)
    assert got.columns == ["k", "v", "v_build"]
    assert bag(got) == sorted([(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (-1, "b", "z")], key=repr)
    assert bag(join(probe, build.where("false"), "k", "k", strategy, n=3)) == []
    left = join(probe, build, "k", "k", strategy, how="left", n=3)
    assert left.count() == 7 and left.where("v_build is null").count() == 3
    safe = join(probe, build, "k", "k", strategy, n=3, null_safe=True)
    assert safe.where("k is null").count() == 1


def test_join_strategies_run_their_operator(catalog):
    def names(strategy, **how):
        rows = join(catalog.table("orders"), catalog.table("customer"), "o_custkey", "c_custkey", strategy, **how)
        return operators(rows)

    assert "BroadcastHashJoin" in names("broadcast")
    assert "BroadcastHashJoin" not in names("broadcast", broadcast_limit=0)
    assert "ShuffledHashJoin" in names("shuffle_hash")
    assert "SortMergeJoin" in names("merge")
    assert "SortMergeJoin" in names("partitioned")
    with pytest.raises(ValueError):
        names("other")


def test_salting_changes_nothing(spark):
    probe = skewed_orders(spark, 3000, 50).drop("amount")
    build = users(spark, 50).select("id", "name")
    plain, salted = (join(probe, build, "user_id", "id", s, n=8) for s in ("auto", "salted"))
    assert plain.exceptAll(salted).count() == salted.exceptAll(plain).count() == 0


def test_only_hot_keys_are_salted(spark):
    probe = spark.range(9000).selectExpr("if(id < 8000, 7L, id) as k", "'x' as v").repartition(3)
    build = spark.createDataFrame([(7, "a"), (8500, "b"), (None, "c")], "k long, w string")
    assert hot_keys(probe, "k", 8) == [7]
    left, right = salted(probe, build, "k", "k", 8, False)
    assert {r["__salt"]: r["count"] for r in left.where("k = 7").groupBy("__salt").count().collect()}.keys() == set(range(8))
    assert left.where("k <> 7 and __salt <> 0").count() == 0
    assert {r["k"]: r["count"] for r in right.groupBy("k").count().collect()} == {7: 8, 8500: 1, None: 1}
    assert join(probe, build, "k", "k", "salted", n=8).groupBy("w").count().orderBy("w").collect() == [("a", 8000), ("b", 1)]
    assert hot_keys(probe.where("false"), "k", 8) == []


def test_generated_tables(spark):
    assert users(spark, 1000).agg(F.min("age"), F.max("age"), F.count("*")).first()[2] == 1000
    paid = orders(spark, 20000, 1000).groupBy("status").count().collect()
    assert abs({r["status"]: r["count"] for r in paid}["paid"] / 20000 - 0.7) < 0.03
    heavy = orders(spark, 20000, 1000).where("user_id <= 50").count() / 20000
    assert abs(heavy - 0.5) < 0.03
    hot = skewed_orders(spark, 20000, 1000).where("user_id = 7").count() / 20000
    assert abs(hot - 0.4) < 0.03


def test_stream_counts_as_the_table(spark, catalog, tmp_path):
    events = catalog.table("events")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    told = (
        tumbling_counts(stream(spark, str(tmp_path / "in"), events, 3), "ts", "event_type", "1 day", late="40 days")
        .writeStream.outputMode("complete").format("memory").queryName("told").start()
    )
    told.processAllAvailable()
    told.stop()
    assert bag(spark.table("told")) == bag(tumbling_counts(events, "ts", "event_type", "1 day"))
