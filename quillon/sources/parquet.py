"""Parquet: scans, sorted copies, and what footers say about skipping."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    above: tuple[str, object] | None = None,
) -> DataFrame:
    """Rows of Parquet data; ``above`` = (column, bound) keeps rows with column > bound. The filter and the
    columns reach the reader, which skips row groups by their statistics and decodes nothing else."""
    rows = spark.read.parquet(path)
    if above is not None:
        rows = rows.where(F.col(above[0]) > F.lit(above[1]))
    return rows if columns is None else rows.select(*columns)


def write_sorted(rows: DataFrame, key: str | Column, path: str, files: int) -> None:
    """Writes rows in ranges of a key, sorted within files, so that bounds on the key skip files' row groups."""
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)


def _footers(spark: SparkSession, path: str, at_once: int = 16):
    """(file, footer) of each data file, through Hadoop's file systems, as Spark reads them; some files at once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(conf).listFiles(root, True), []
    while files.hasNext():
        where = files.next().getPath()
        if where.getName().endswith(".parquet"):
            found.append(where)

    def footer(where):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf)
        )
        try:
            return where.toString(), reader.getFooter()
        finally:
            reader.close()

    with ThreadPoolExecutor(at_once) as pool:
        yield from pool.map(footer, found)


def layout(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column of each row group: rows, bytes, codec, encodings, least and greatest value, nulls.
    Footers are read on the driver, some
    files at once: for data of some thousand files."""
    rows = []
    for file, footer in _footers(spark, path):
        for group, block in enumerate(footer.getBlocks()):
            for column in block.getColumns():
                stats = column.getStatistics()
                known = stats is not None and stats.hasNonNullValue()
                rows.append((
                    file, group, block.getRowCount(), column.getPath().toDotString(), column.getTotalSize(),
                    column.getTotalUncompressedSize(), column.getCodec().toString(),
                    sorted(e.toString() for e in column.getEncodings()),
                    stats.minAsString() if known else None, stats.maxAsString() if known else None,
                    stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None,
                ))
    return spark.createDataFrame(
        rows,
        "file string, row_group int, n_rows long, column string, bytes long, bytes_raw long, codec string, "
        "encodings array<string>, least string, greatest string, nulls long",
    )


@dataclass(frozen=True)
class Skipping:
    """How many row groups a bound reads and skips."""

    read: int
    skipped: int


def skipping(spark: SparkSession, path: str, column: str, bound: object) -> Skipping:
    """Row groups that ``column > bound`` reads, by their statistics; groups without statistics are read. Bounds are
    compared as values of the column's type, whatever it is."""
    kind = spark.read.parquet(path).schema[column].dataType
    groups = layout(spark, path).where(F.col("column") == column)
    past = F.col("greatest").cast(kind) <= F.lit(bound)
    # a group of nulls only holds nothing above any bound; Parquet has no least and greatest value for it
    empty = F.col("greatest").isNull() & (F.col("nulls") == F.col("n_rows"))
    skipped = F.count_if(F.coalesce(past, F.lit(False)) | F.coalesce(empty, F.lit(False)))
    total, out = groups.agg(F.count("*"), skipped).first()
    return Skipping(total - out, out)


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column: rows, nulls and the least and greatest value as text, from footers alone."""
    groups = layout(spark, path)
    kinds = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    parts = []
    for name, kind in kinds.items():
        own = groups.where(F.col("column") == name)
        low, high = F.min(F.col("least").cast(kind)), F.max(F.col("greatest").cast(kind))
        parts.append(own.agg(
            F.lit(name).alias("column"), F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"),
            low.cast("string").alias("least"), high.cast("string").alias("greatest"),
        ))
    return functools.reduce(DataFrame.union, parts)
