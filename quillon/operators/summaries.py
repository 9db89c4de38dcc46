"""Projection, the strict bound, and the two summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def project(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns in the order asked for; one may come twice."""
    return rows.select(*columns)


def above(rows: DataFrame, column: str, bound: object, nan: bool = True) -> DataFrame:
    """Rows with column > bound. Null is never above. NaN is above everything, as in SQL here; nan=False drops it,
    as a comparison of machine numbers does."""
    kept = F.col(column) > F.lit(bound)
    if not nan and isinstance(rows.schema[column].dataType, (T.FloatType, T.DoubleType)):
        kept = kept & ~F.isnan(column)
    return rows.where(kept)


def _exact_sum(rows: DataFrame, column: str, scale: int | None) -> Column:
    """A sum as long for whole numbers; with a scale by decimals, which adds in any order to the same."""
    if isinstance(rows.schema[column].dataType, WHOLE):
        return F.sum(column).cast("long")
    if scale is None:
        return F.sum(column).cast("double")
    return F.sum(F.col(column).cast(f"decimal(18,{scale})")).cast("double")


def _widened(rows: DataFrame, column: str, value: Column) -> Column:
    return value.cast("long") if isinstance(rows.schema[column].dataType, WHOLE) else value


def summarize(rows: DataFrame, column: str, scale: int | None = None) -> DataFrame:
    """One row: count of all rows, sum (0 of nothing), avg, min, max of a column."""
    zero = F.lit(0).cast("long" if isinstance(rows.schema[column].dataType, WHOLE) else "double")
    return rows.agg(
        F.count("*").alias("count"),
        F.coalesce(_exact_sum(rows, column, scale), zero).alias("sum"),
        F.avg(column).alias("avg"),
        _widened(rows, column, F.min(column)).alias("min"),
        _widened(rows, column, F.max(column)).alias("max"),
    )


def group_summary(rows: DataFrame, key: str, column: str, scale: int | None = None, digits: int | None = None) -> DataFrame:
    """A row for each key (null is one): the key, count of values that are not null, their sum and avg."""
    mean = F.col("sum").cast("double") / F.nullif(F.col("count"), F.lit(0))
    sums = rows.groupBy(key).agg(F.count(column).alias("count"), _exact_sum(rows, column, scale).alias("sum"))
    return sums.select(key, "count", "sum", (mean if digits is None else F.round(mean, digits)).alias("avg"))
