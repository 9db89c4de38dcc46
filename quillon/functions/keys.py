"""How keys fall into partitions, and how much of the rows few keys hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partition_counts(rows: DataFrame, key: str | Column, partitions: int = 16) -> DataFrame:
    """(part, n): rows in each partition of abs(key) modulo the number of partitions."""
    value = F.col(key) if isinstance(key, str) else key
    return rows.groupBy((F.abs(value) % partitions).alias("part")).agg(F.count("*").alias("n"))


def partition_shares(rows: DataFrame, key: str | Column, partitions: int = 16) -> DataFrame:
    """(part, n, pct): with the share of all rows. The counts are as few as partitions, so that their sum is cheap."""
    counts = partition_counts(rows, key, partitions)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("part", "n", (F.col("n").cast("double") * 100 / F.col("total")).alias("pct"))


def imbalance(rows: DataFrame, key: str | Column, partitions: int = 16) -> DataFrame:
    """One row: least and most rows of a partition and their ratio."""
    counts = partition_counts(rows, key, partitions)
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn(
        "ratio", F.col("most").cast("double") / F.col("least")
    )


def _per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def key_stats(rows: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, rows, and least, most, mean and median rows of a key."""
    return _per_key(rows, key).agg(
        F.count("*").alias("distinct_keys"),
        F.sum("n").cast("long").alias("total"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.round(F.avg("n"), 6).alias("mean_n"),
        F.median("n").alias("median_n"),
    )


def key_top_share(rows: DataFrame, key: str, percents: tuple[float, ...] = (0.1, 1.0, 5.0)) -> DataFrame:
    """(pct, held, total): rows that the most frequent pct percent of the keys (one at least) hold.

    Keys of one count are alike, so the keys are first counted by their count: what is ranked in one task is the
    distinct counts, which are few however many keys there are."""
    sizes = _per_key(rows, key).groupBy("n").agg(F.count("*").alias("keys"))
    whole = sizes.agg(F.sum("keys").alias("d"), F.sum(F.col("n") * F.col("keys")).alias("total"))
    before = F.sum("keys").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = sizes.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(whole))
    each = ranked.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    top = F.greatest(F.lit(1).cast("long"), F.floor(F.col("d") * F.col("pct") / 100))
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("keys"), top - F.col("before")))
    return each.groupBy("pct").agg(
        F.sum(F.col("n") * taken).cast("long").alias("held"), F.max("total").cast("long").alias("total")
    )
