"""The query suite over the star schema, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions import keys
from .operators.joins import join
from .operators.summaries import above, group_summary, project, summarize
from .plans.report import metrics
from .sources import generated
from .sources.catalog import Catalog
from .sources.parquet import bounds, layout, scan, skipping
from .streaming.windows import tumbling_counts

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of a catalog under its name, with the SQL that says the same."""

    def add(make: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Catalog.of_folder(spark, sf_dir, TABLES))

        QUERIES[make.__name__] = run
        if oracle:
            ORACLES[make.__name__] = oracle
        return make

    return add


# scans, filters, projections


@query("select * from customer")
def scan_star(c: Catalog) -> DataFrame:
    return c.table("customer")


@query("select c_name, c_acctbal from customer")
def scan_columns(c: Catalog) -> DataFrame:
    return scan(c.spark, c.path("customer"), ["c_name", "c_acctbal"])


@query("select c_custkey, c_name from customer where c_custkey > 1470")
def filter_gt_sorted(c: Catalog) -> DataFrame:
    return scan(c.spark, c.path("customer"), ["c_custkey", "c_name"], above=("c_custkey", 1470))


@query("select c_name from customer where c_acctbal > 9000.5")
def filter_gt_random(c: Catalog) -> DataFrame:
    return project(above(c.table("customer"), "c_acctbal", 9000.5), "c_name")


@query("select c_name from customer where c_name > 'Customer#000001400'")
def filter_gt_string(c: Catalog) -> DataFrame:
    return project(above(c.table("customer"), "c_name", "Customer#000001400"), "c_name")


@query("select * from customer where c_acctbal > 9000")
def star_filtered(c: Catalog) -> DataFrame:
    return above(c.table("customer"), "c_acctbal", 9000)


@query("select o_orderkey from orders where o_custkey > 700 and o_totalprice > 100000")
def filter_stacked(c: Catalog) -> DataFrame:
    return project(above(above(c.table("orders"), "o_custkey", 700), "o_totalprice", 100000), "o_orderkey")


@query("select c_name as name, c_acctbal as balance from customer where c_acctbal > 9000.5")
def sql_alias(c: Catalog) -> DataFrame:
    return Engine(c).sql("SELECT c.c_name AS name, c.c_acctbal AS balance FROM customer c WHERE c.c_acctbal > 9000.5D")


@query("select c_name from customer where c_nationkey > 20 and c_acctbal > 0")
def project_stacked(c: Catalog) -> DataFrame:
    wide = project(above(c.table("customer"), "c_nationkey", 20), "c_name", "c_acctbal")
    return project(above(wide, "c_acctbal", 0), "c_name")


# summaries

BUNDLE = (
    "select count(*) as count, coalesce(cast(sum(c_nationkey) as bigint),0) as sum, avg(c_nationkey) as avg, "
    "cast(min(c_nationkey) as bigint) as min, cast(max(c_nationkey) as bigint) as max from customer where "
)


@query(BUNDLE + "c_acctbal > 3000")
def agg_bundle(c: Catalog) -> DataFrame:
    return summarize(above(c.table("customer"), "c_acctbal", 3000), "c_nationkey")


@query(BUNDLE + "c_custkey > 99999999")
def agg_bundle_empty(c: Catalog) -> DataFrame:
    return summarize(above(c.table("customer"), "c_custkey", 99999999), "c_nationkey")


@query(
    "select c_mktsegment, count(c_nationkey) as count, cast(sum(c_nationkey) as bigint) as sum, "
    "cast(sum(c_nationkey) as double)/count(c_nationkey) as avg from customer group by c_mktsegment"
)
def group_bundle(c: Catalog) -> DataFrame:
    return group_summary(c.table("customer"), "c_mktsegment", "c_nationkey")


@query(
    "select l_returnflag, count(l_extendedprice) as count, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) "
    "as sum, round(cast(sum(cast(l_extendedprice as decimal(18,2))) as double)/count(l_extendedprice),6) as avg "
    "from lineitem group by l_returnflag"
)
def group_bundle_double(c: Catalog) -> DataFrame:
    return group_summary(c.table("lineitem"), "l_returnflag", "l_extendedprice", scale=2, digits=6)


@query("select c_mktsegment, count(*) as count from customer group by c_mktsegment")
def group_count(c: Catalog) -> DataFrame:
    return Engine(c).sql("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment")


@query("select c_nationkey, count(*) as count from customer group by c_nationkey having count(*) > 60")
def group_having(c: Catalog) -> DataFrame:
    return above(c.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("count")), "count", 60)


# joins

INNER = "select o.o_custkey, o.o_totalprice, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey"


def _orders_customers(c: Catalog, strategy: str) -> DataFrame:
    probe = c.table("orders").select("o_custkey", "o_totalprice")
    return join(probe, c.table("customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", strategy)


@query(INNER)
def join_inner(c: Catalog) -> DataFrame:
    return _orders_customers(c, "auto")


@query(INNER)
def join_inner_broadcast(c: Catalog) -> DataFrame:
    return _orders_customers(c, "broadcast")


@query(INNER)
def join_inner_shuffle_hash(c: Catalog) -> DataFrame:
    return _orders_customers(c, "shuffle_hash")


@query(INNER)
def join_inner_merge(c: Catalog) -> DataFrame:
    return _orders_customers(c, "merge")


@query(INNER)
def join_inner_partitioned16(c: Catalog) -> DataFrame:
    return _orders_customers(c, "partitioned")


@query(INNER + " where c.c_custkey > 750")
def join_partial(c: Catalog) -> DataFrame:
    build = above(c.table("customer"), "c_custkey", 750).select("c_custkey", "c_name")
    return join(c.table("orders").select("o_custkey", "o_totalprice"), build, "o_custkey", "c_custkey")


@query("select o.o_orderkey, l.l_linenumber from orders o join lineitem l on o.o_orderkey = l.l_orderkey")
def join_dup_build(c: Catalog) -> DataFrame:
    return join(
        c.table("orders").select("o_orderkey"), c.table("lineitem").select("l_orderkey", "l_linenumber"),
        "o_orderkey", "l_orderkey",
    )


@query(
    "select o.k, o.o_orderkey, c.c_name from (select nullif(o_custkey, 7) as k, o_orderkey from orders) o "
    "join (select nullif(c_custkey,7) as ck, c_name from customer) c on o.k = c.ck"
)
def join_null_key(c: Catalog) -> DataFrame:
    probe = c.table("orders").select(F.nullif(F.col("o_custkey"), F.lit(7)).alias("k"), "o_orderkey")
    return join(probe, c.table("customer").select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("ck"), "c_name"), "k", "ck")


HOT = "case when event_id % 10 < 4 then 7 else user_id end"


@query(
    f"select e.event_id, e.k, c.c_name from (select event_id, {HOT} as k from events) e "
    "join customer c on e.k = c.c_custkey"
)
def join_skewed_salted(c: Catalog) -> DataFrame:
    probe = c.table("events").select("event_id", F.expr(HOT).alias("k"))
    return join(probe, c.table("customer").select("c_custkey", "c_name"), "k", "c_custkey", "salted", n=8)


# reports on keys


@query("select abs(c_custkey) % 16 as part, count(*) as n from customer group by abs(c_custkey) % 16")
def partition_build(c: Catalog) -> DataFrame:
    return keys.partition_counts(c.table("customer"), "c_custkey")


@query("select abs(o_custkey) % 16 as part, count(*) as n from orders group by abs(o_custkey) % 16")
def partition_probe(c: Catalog) -> DataFrame:
    return keys.partition_counts(c.table("orders"), "o_custkey")


@query(
    f"with e as (select {HOT} as k from events) select k % 16 as part, count(*) as n, "
    "cast(count(*) as double)*100/(select count(*) from events) as pct from e group by k % 16"
)
def skew_hot_key(c: Catalog) -> DataFrame:
    return keys.partition_shares(c.table("events"), F.expr(HOT))


@query(
    f"with e as (select abs({HOT}) % 16 as part, count(*) as n from events group by 1) "
    "select min(n) as least, max(n) as most, cast(max(n) as double) / min(n) as ratio from e"
)
def skew_imbalance(c: Catalog) -> DataFrame:
    return keys.imbalance(c.table("events"), F.expr(HOT))


@query(
    "with g as (select o_custkey, count(*) as n from orders group by o_custkey) select count(*) as distinct_keys, "
    "cast(sum(n) as bigint) as total, min(n) as min_n, max(n) as max_n, round(avg(n),6) as mean_n, "
    "median(n) as median_n from g"
)
def key_stats(c: Catalog) -> DataFrame:
    return keys.key_stats(c.table("orders"), "o_custkey")


@query(
    "with g as (select o_custkey, count(*) as n from orders group by o_custkey), r as (select n, row_number() over "
    "(order by n desc, o_custkey) as rk, count(*) over () as d from g) select p.pct, cast(sum(case when rk <= "
    "greatest(1, cast(floor(d*p.pct/100) as bigint)) then n else 0 end) as bigint) as held, "
    "cast(sum(n) as bigint) as total from r cross join "
    "(values (cast(0.1 as double)),(cast(1 as double)),(cast(5 as double))) p(pct) group by p.pct"
)
def key_top_share(c: Catalog) -> DataFrame:
    return keys.key_top_share(c.table("orders"), "o_custkey")


@query()
def parquet_layout(c: Catalog) -> DataFrame:
    return layout(c.spark, c.path("lineitem"))


@query(
    " union all ".join(
        f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as nulls, cast(min({c}) as varchar) as least, "
        f"cast(max({c}) as varchar) as greatest from lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    )
)
def parquet_bounds(c: Catalog) -> DataFrame:
    """What the footers say of the columns that SQL writes as text as Spark does."""
    rows = bounds(c.spark, c.path("lineitem"))
    return rows.where("column not in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')")


@query()
def scan_report(c: Catalog) -> DataFrame:
    """Row groups that bounds on a column in file order and on one in no order read and skip."""
    rows = []
    for column, share in (("l_orderkey", 0.95), ("l_quantity", 0.98)):
        top = c.table("lineitem").agg(F.max(column)).first()[0]
        found = skipping(c.spark, c.path("lineitem"), column, top * share)
        rows.append((column, float(top * share), found.read, found.skipped))
    return c.spark.createDataFrame(rows, "column string, bound double, groups_read int, groups_skipped int")


@query()
def join_report(c: Catalog) -> DataFrame:
    """What the operators of a merge join counted: rows, bytes shuffled, bytes spilled, partitions."""
    counted = metrics(_orders_customers(c, "merge"))
    rows = [(k, name, counter, value) for k, (name, own) in enumerate(counted) for counter, value in sorted(own.items())]
    return c.spark.createDataFrame(rows, "place int, operator string, counter string, value long")


@query()
def gen_users(c: Catalog) -> DataFrame:
    return generated.users(c.spark, 5_000_000)


@query()
def gen_orders(c: Catalog) -> DataFrame:
    return generated.orders(c.spark, 20_000_000, 5_000_000)


@query()
def gen_skewed_orders(c: Catalog) -> DataFrame:
    return generated.skewed_orders(c.spark, 20_000_000, 5_000_000)


# what the generators promise, exactly or to the hundredth


@query(
    "select 5000000::bigint as n, 1::bigint as low, 5000000::bigint as high, 18 as youngest, 80 as oldest, "
    "10::bigint as cities, 0.1::double as least_city, 0::bigint as wrong_names"
)
def gen_users_facts(c: Catalog) -> DataFrame:
    cities = generated.users(c.spark, 5_000_000).groupBy("city").agg(
        F.count("*").alias("own"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.min("age").alias("young"), F.max("age").alias("old"),
        F.sum((F.col("name") != F.concat(F.lit("user_"), F.col("id").cast("string"))).cast("long")).alias("wrong"),
    )
    return cities.agg(
        F.sum("own").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("young").cast("int").alias("youngest"), F.max("old").cast("int").alias("oldest"),
        F.count("*").alias("cities"), F.round(F.min("own") / F.sum("own"), 2).alias("least_city"),
        F.sum("wrong").alias("wrong_names"),
    )


@query(
    "select * from (values ('paid', 0.70::double), ('pending', 0.15::double), ('cancelled', 0.10::double), "
    "('refunded', 0.05::double)) s(status, share) cross join (select 20000000::bigint as n, 1::bigint as low, "
    "20000000::bigint as high, 0.5::double as heavy, 10.0::double as least, 5000.0::double as most)"
)
def gen_orders_facts(c: Catalog) -> DataFrame:
    per = generated.orders(c.spark, 20_000_000, 5_000_000).groupBy("status").agg(
        F.count("*").alias("own"), F.min("order_id").alias("low"), F.max("order_id").alias("high"),
        F.sum((F.col("user_id") <= 250_000).cast("long")).alias("few"),
        F.min("amount").alias("least"), F.max("amount").alias("most"),
    )
    whole = per.agg(
        F.sum("own").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.round(F.sum("few") / F.sum("own"), 2).alias("heavy"),
        F.round(F.min("least"), 0).alias("least"), F.round(F.max("most"), 0).alias("most"),
    )
    return per.select("status", "own").join(F.broadcast(whole)).select(
        "status", F.round(F.col("own") / F.col("n"), 2).alias("share"), "n", "low", "high", "heavy", "least", "most"
    )


@query(
    "select 20000000::bigint as n, 1::bigint as low, 20000000::bigint as high, 0.4::double as hot, 0::bigint as outside, "
    "7::bigint as hot_user"
)
def gen_skewed_orders_facts(c: Catalog) -> DataFrame:
    rows = generated.skewed_orders(c.spark, 20_000_000, 5_000_000)
    per = rows.groupBy("user_id").agg(
        F.count("*").alias("own"), F.min("order_id").alias("low"), F.max("order_id").alias("high")
    )
    return per.agg(
        F.sum("own").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.round(F.max("own") / F.sum("own"), 2).alias("hot"),
        F.sum((~F.col("user_id").between(1, 5_000_000)).cast("long")).alias("outside"),
        F.max_by("user_id", "own").alias("hot_user"),
    )


@query(
    "select 'scan of orders' as what, count(*) as n from orders union all select 'scan of customer', count(*) from customer "
    "union all select 'joined', count(*) from orders join customer on o_custkey = c_custkey"
)
def join_counters(c: Catalog) -> DataFrame:
    """Rows that the scans and the join of a merge join counted while it ran."""
    counted = metrics(_orders_customers(c, "merge"))
    made = lambda part: [own["numOutputRows"] for name, own in counted if part in name and "numOutputRows" in own]
    sides = sorted(made("Scan"))
    rows = [("scan of customer", sides[0]), ("scan of orders", sides[-1]), ("joined", made("SortMergeJoin")[0])]
    return c.spark.createDataFrame(rows, "what string, n long")


@query("select count(*) filter (where l_quantity > 49) as kept, count(*) as in_groups_read from lineitem")
def scan_counters(c: Catalog) -> DataFrame:
    """Rows that a filtered scan read, counted by the reader, and rows that the filter left."""
    rows = scan(c.spark, c.path("lineitem"), ["l_orderkey"], above=("l_quantity", 49))
    counted = metrics(rows)
    read = next(own["numOutputRows"] for name, own in counted if "Scan" in name)
    kept = next(own["numOutputRows"] for name, own in counted if "Filter" in name)
    return c.spark.createDataFrame([(kept, read)], "kept long, in_groups_read long")


# the flagship


def _flagship(c: Catalog) -> DataFrame:
    """Orders over a price, joined with their customers, summarised by segment."""
    probe = above(c.table("orders"), "o_totalprice", 100000).select("o_custkey", "o_totalprice")
    joined = join(probe, c.table("customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")
    return group_summary(joined, "c_mktsegment", "o_totalprice", scale=2, digits=6)


@query(
    "select c.c_mktsegment, count(*) as count, cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as sum, "
    "round(cast(sum(cast(o.o_totalprice as decimal(18,2))) as double)/count(*),6) as avg from orders o "
    "join customer c on o.o_custkey=c.c_custkey where o.o_totalprice > 100000 group by c.c_mktsegment"
)
def flagship_segments(c: Catalog) -> DataFrame:
    return _flagship(c)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(Catalog.of_folder(spark, sf_dir, TABLES))


# what SQL brings beyond these


@query(
    "select o_orderkey from orders where (o_totalprice >= 100000 and o_totalprice < 200000) or o_orderstatus = 'P' "
    "and o_custkey <> 5"
)
def x_cmp_bool(c: Catalog) -> DataFrame:
    price = F.col("o_totalprice")
    wanted = ((price >= 100000) & (price < 200000)) | ((F.col("o_orderstatus") == "P") & (F.col("o_custkey") != 5))
    return c.table("orders").where(wanted).select("o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def x_topk(c: Catalog) -> DataFrame:
    return c.table("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query(
    "select l_returnflag, l_linestatus, count(*) as n, min(l_quantity) as mn, max(l_quantity) as mx from lineitem "
    "group by l_returnflag, l_linestatus"
)
def x_group2(c: Catalog) -> DataFrame:
    return c.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("mn"), F.max("l_quantity").alias("mx")
    )


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)")
def x_rollup(c: Catalog) -> DataFrame:
    return c.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey=o.o_custkey "
    "and o.o_totalprice > 400000"
)
def x_left_join(c: Catalog) -> DataFrame:
    build = above(c.table("orders"), "o_totalprice", 400000).select("o_custkey", "o_orderkey")
    return join(c.table("customer").select("c_custkey"), build, "c_custkey", "o_custkey", how="left")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def x_semi(c: Catalog) -> DataFrame:
    build = above(c.table("orders"), "o_totalprice", 400000).select("o_custkey")
    return join(c.table("customer").select("c_custkey"), build, "c_custkey", "o_custkey", how="left_semi")


@query(
    "select c_custkey from customer where not exists (select 1 from orders where o_custkey=c_custkey "
    "and o_totalprice > 400000)"
)
def x_anti(c: Catalog) -> DataFrame:
    build = above(c.table("orders"), "o_totalprice", 400000).select("o_custkey")
    return join(c.table("customer").select("c_custkey"), build, "c_custkey", "o_custkey", how="left_anti")


@query(
    "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn "
    "from orders"
)
def x_window(c: Catalog) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return c.table("orders").select("o_orderkey", F.row_number().over(by).cast("long").alias("rn"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def x_distinct(c: Catalog) -> DataFrame:
    return c.table("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "select c_nationkey from customer where c_acctbal > 5000 intersect select n_nationkey from nation "
    "where n_regionkey > 1"
)
def x_setops(c: Catalog) -> DataFrame:
    held = above(c.table("customer"), "c_acctbal", 5000).select("c_nationkey")
    return held.intersect(above(c.table("nation"), "n_regionkey", 1).select("n_nationkey"))


@query("select o_orderstatus, count(distinct o_custkey) as n from orders group by o_orderstatus")
def x_count_distinct(c: Catalog) -> DataFrame:
    return c.table("orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n"))


@query("select event_type, date_trunc('hour', ts) as h, count(*) as n from events group by event_type, date_trunc('hour', ts)")
def x_tumble(c: Catalog) -> DataFrame:
    return tumbling_counts(c.table("events"), "ts", "event_type")
