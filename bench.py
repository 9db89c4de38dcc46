"""Times the headline queries: a discarded warm-up, then the median of runs, and prints one line of JSON.

tables of the same sizes (5,000,000 users, 20,000,000 orders), each also in DuckDB over the same files, with the
results compared. ``shapes`` has (seconds, DuckDB's seconds, published seconds) of each; BENCH_SHAPES=0 leaves them out."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINES = [
    "scan_star", "scan_columns", "filter_gt_sorted", "filter_gt_random", "star_filtered", "filter_stacked", "agg_bundle",
    "group_bundle", "group_bundle_double", "group_count", "join_inner", "join_inner_broadcast",
    "join_inner_shuffle_hash", "join_inner_merge", "join_inner_partitioned16", "join_dup_build", "join_skewed_salted",
    "key_stats", "key_top_share", "flagship_segments", "x_window", "x_topk",
]


#: The published shapes: the SQL and the published seconds.
SHAPES = {
    "read_all": ("select * from users", 0.0845),
    "read_age": ("select age from users", 0.0081),
    "read_id_age": ("select id, age from users", 0.0266),
    "filter_sorted": ("select * from users where id > 4900000", 0.041),
    "star_filtered": ("select * from users where age > 79", 0.342),
    "filter_random": ("select * from users where age > 70", 0.402),
    "group_count": ("select city, count(*) as n from users group by city", 0.210),
    "group_bundle": ("select city, count(age) as n, sum(age) as s, avg(age) as m from users group by city", 0.277),
    "join": ("select o.order_id, o.user_id, o.amount, u.name from orders o join users u on o.user_id = u.id", 4.083),
    "join_skewed": ("select o.order_id, o.amount, u.name from skewed o join users u on o.user_id = u.id", None),
}


def median_seconds(run, runs: int = RUNS) -> float:
    seconds = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - began)
    return round(statistics.median(seconds[1:]), 4)


def shapes(spark) -> dict[str, list]:
    """[seconds, DuckDB's seconds, published seconds] of each shape; an error if the results differ."""
    import duckdb

    from quillon import Catalog, Engine
    from quillon.sources import generated

    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        made = {
            "users": generated.users(spark, 5_000_000).repartitionByRange(10, "id").sortWithinPartitions("id"),
            "orders": generated.orders(spark, 20_000_000, 5_000_000),
            "skewed": generated.skewed_orders(spark, 20_000_000, 5_000_000),
        }
        duck, out = duckdb.connect(config={"threads": int(CPUS)}), {}
        for name, rows in made.items():
            rows.write.parquet(f"{folder}/{name}.parquet")
            duck.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
        engine = Engine(Catalog.of_folder(spark, folder, list(made)))
        for name, (sql, published) in SHAPES.items():
            ours = lambda sql=sql: engine.sql(sql).write.format("noop").mode("overwrite").save()
            theirs = lambda sql=sql: duck.execute(f"create or replace temp table answer as {sql}")
            column = engine.sql(sql).columns[0]
            digest = f"select count(*), sum(cast(hash_of as bigint)) from (select length(cast({column} as string)) as hash_of from ({sql}) q) r"
            if tuple(engine.sql(digest).first()) != tuple(duck.execute(digest).fetchone()):
                raise AssertionError(f"{name}: results differ")
            out[name] = [median_seconds(ours), median_seconds(theirs), published]
        return out
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    from quillon.queries import QUERIES
    from quillon.session import session

    spark = session(
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINES:
        took[name] = median_seconds(lambda name=name: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    compared = shapes(spark) if os.environ.get("BENCH_SHAPES", "1") != "0" else {}
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec",
        "queries": took, "sf": Path(SF).name.removeprefix("sf"), "runs": RUNS, "cpus": int(CPUS),
        "shapes": compared,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
