"""Names of tables and what is behind them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


class UnknownTable(LookupError):
    """A name that the catalog doesn't have."""


class Catalog:
    """Table names, in any case, to paths of Parquet data that Spark can read."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, str]):
        self.spark = spark
        self._paths = {name.lower(): path for name, path in tables.items()}
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        return cls(spark, {name: f"{folder}/{name}.parquet" for name in names})

    @property
    def names(self) -> list[str]:
        return sorted(self._paths)

    def path(self, name: str) -> str:
        try:
            return self._paths[name.lower()]
        except KeyError:
            raise UnknownTable(f"no table {name!r}; there are {', '.join(self.names)}") from None

    def table(self, name: str) -> DataFrame:
        """The whole table; its schema is read once."""
        path = self.path(name)
        if name.lower() not in self._frames:
            self._frames[name.lower()] = self.spark.read.parquet(path)
        return self._frames[name.lower()]

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def first_numeric_column(self, name: str) -> str:
        """The first integer or floating column (decimals don't count)."""
        for field in self.schema(name):
            if isinstance(field.dataType, NUMBERS):
                return field.name
        raise ValueError(f"table {name!r} has no numeric column")
