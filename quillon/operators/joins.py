"""The equi-join, with a choice of how it is carried out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("auto", "broadcast", "shuffle_hash", "merge", "partitioned", "salted")


def estimated_bytes(rows: DataFrame) -> int:
    """What the optimizer takes the size to be."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(
    probe: DataFrame,
    build: DataFrame,
    probe_key: str,
    build_key: str,
    strategy: str = "auto",
    how: str = "inner",
    n: int = 16,
    null_safe: bool = False,
    suffix: str = "_build",
    broadcast_limit: int = 64 << 20,
) -> DataFrame:
    """Rows of probe with the matching rows of build: all columns of probe, then those of build but its key, with
    a suffix where a name is taken. Each match is a row; null keys match nothing unless null_safe.

    auto: the optimizer chooses. broadcast: build is sent to every executor if it is estimated at no more than
    ``broadcast_limit`` bytes, else the join is a merge. shuffle_hash: both sides are dealt by key and the build
    side hashed. merge: both sides are dealt and sorted, and spill. partitioned: as merge, with n partitions.
    salted: probe rows of hot keys, those with over an n-th of the probe rows, are dealt in turn to n places, with a
    copy of the key's build rows in each; other keys are not touched. Counting the keys is a job of its own, and of
    hot keys there are fewer than n."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {', '.join(STRATEGIES)}")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how {how!r} isn't supported")
    taken = {c.lower() for c in probe.columns}
    key = "__build_key"
    renamed = [
        F.col(c).alias(c + suffix if c.lower() in taken else c) for c in build.columns if c.lower() != build_key.lower()
    ]
    names = [c + suffix if c.lower() in taken else c for c in build.columns if c.lower() != build_key.lower()]
    if len({x.lower() for x in names} | taken) < len(names) + len(taken):
        raise ValueError(f"names clash even with the suffix {suffix!r}")
    right, left = build.select(F.col(build_key).alias(key), *renamed), probe
    on = left[probe_key].eqNullSafe(right[key]) if null_safe else left[probe_key] == right[key]
    if strategy == "broadcast":
        right = right.hint("broadcast" if estimated_bytes(right) <= broadcast_limit else "merge")
    elif strategy in ("shuffle_hash", "merge"):
        right = right.hint(strategy)
    elif strategy == "partitioned":
        left, right = left.repartition(n, probe_key), right.repartition(n, key).hint("merge")
        on = left[probe_key].eqNullSafe(right[key]) if null_safe else left[probe_key] == right[key]
    elif strategy == "salted":
        left, right = salted(left, right, probe_key, key, n, null_safe)
        on = left[probe_key].eqNullSafe(right[key]) if null_safe else left[probe_key] == right[key]
        on = on & (left["__salt"] == right["__salt_build"])
    joined = left.join(right, on, how)
    return joined.select(*probe.columns, *(names if how in ("inner", "left") else []))


def hot_keys(rows: DataFrame, key: str, n: int) -> list:
    """Values of a key, null left out, that more than an n-th of the rows have: fewer than n."""
    counts = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    return [r["k"] for r in counts.join(F.broadcast(total), F.col("c") * n > F.col("total")).where("k is not null").collect()]


def salted(
    probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, n: int, null_safe: bool
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: 0, but for hot keys, whose probe rows get 0 to n - 1 in turn and whose build rows are
    there n times. Probe rows without a key, which find nothing, are dealt in turn, too."""
    hot = hot_keys(probe, probe_key, n)
    turn, zero = F.pmod(F.monotonically_increasing_id(), F.lit(n)), F.lit(0).cast("long")
    is_hot = lambda c: F.coalesce(F.col(c).isin(hot), F.lit(False)) if hot else F.lit(False)
    dealt = is_hot(probe_key) if null_safe else is_hot(probe_key) | F.col(probe_key).isNull()
    copies = F.when(is_hot(build_key), F.sequence(zero, F.lit(n - 1).cast("long"))).otherwise(F.array(zero))
    return probe.withColumn("__salt", F.when(dealt, turn).otherwise(zero)), build.withColumn("__salt_build", F.explode(copies))
