"""Generated tables of any size: users, orders with heavy users, orders with one hot user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of the states of an order.
STATES = {"paid": 0.70, "pending": 0.15, "cancelled": 0.10, "refunded": 0.05}
CITIES = ["Ankara", "Berlin", "Cairo", "Delhi", "Lagos", "Lima", "London", "Paris", "Seoul", "Tokyo"]


def _even(seed: int, *salt: object) -> Column:
    """A number in [0, 1) that depends on the row's id only, so that a task that runs again makes the same rows."""
    bits = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), 11)
    return bits.cast("double") / float(1 << 53)


def users(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id 1..n in order, name, age evenly 18..80, city."""
    cities = F.array(*map(F.lit, CITIES))
    return spark.range(1, n + 1).select(
        "id",
        F.concat(F.lit("user_"), F.col("id").cast("string")).alias("name"),
        (18 + F.floor(_even(seed, "age") * 63)).cast("byte").alias("age"),
        F.get(cities, F.floor(_even(seed, "city") * len(CITIES)).cast("int")).alias("city"),
    )


def _order(user: Column, seed: int) -> list[Column]:
    return [
        F.col("id").alias("order_id"),
        user.cast("long").alias("user_id"),
        F.round(10 + _even(seed, "amount") * 4990, 2).alias("amount"),
    ]


def orders(spark: SparkSession, n: int, n_users: int, heavy: float = 0.05, seed: int = 43) -> DataFrame:
    """Half of the orders go to the first ``heavy`` share of the users, half to the others."""
    few = max(1, int(n_users * heavy))
    pick = _even(seed, "user")
    user = F.when(_even(seed, "half") < 0.5, 1 + F.floor(pick * few)).otherwise(
        1 + few + F.floor(pick * max(1, n_users - few))
    )
    state, upto = None, 0.0
    for name, share in STATES.items():
        upto += share
        hit = _even(seed, "state") < upto
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return spark.range(1, n + 1).select(*_order(user, seed), state.otherwise("refunded").alias("status"))


def skewed_orders(spark: SparkSession, n: int, n_users: int, hot: int = 7, share: float = 0.4, seed: int = 44) -> DataFrame:
    """A share of the orders goes to one user."""
    user = F.when(_even(seed, "hot") < share, hot).otherwise(1 + F.floor(_even(seed, "user") * n_users))
    return spark.range(1, n + 1).select(*_order(user, seed))
