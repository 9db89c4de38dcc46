"""Shared parts of the corpus operators: the shared folder, written tables, words, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java character class and as the characters themselves.
SPACES = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Gives the workers this package through Spark's file server where their path doesn't already hold it."""
    few_rows_at_once(spark)
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(root) in known or getattr(spark.sparkContext, "_quillon_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quillon", "zip", root, "quillon"))
    spark.sparkContext._quillon_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's spark.checkpoint.dir. Only where that is unset (a local
    session, as in tests) a folder of our own is made and set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: How many rows go to a Python worker at once: rows with texts or sets are long. Set for the session where it still
#: has Spark's default, and left so, since the last stage of a query runs when its caller asks.
BATCH_SETTING, SPARKS_DEFAULT, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "100"


#: Of each thread, the scopes that it is in, innermost last.
_open = threading.local()


def few_rows_at_once(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING) == SPARKS_DEFAULT:
        spark.conf.set(BATCH_SETTING, ROWS_AT_ONCE)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    few_rows_at_once(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread writes inside are deleted at the end, but for those given to what it yields."""
    tables: list[DataFrame] = []
    keep: list[DataFrame] = []
    _open.scopes = [*getattr(_open, "scopes", []), tables]
    try:
        yield lambda table: keep.append(table) or table
        release(*(t for t in tables if not any(t is k for k in keep)))
    finally:
        _open.scopes = _open.scopes[:-1]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function of a stage in Python, after which the worker gives its free memory back: workers live on, and
    what one stage had needed would stand beside what the next ones need."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def release(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads."""
    for table in tables:
        path = getattr(table, "_quillon_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the filter of keys, which is at most 2 ** 18 rows of 64 bits.
FILTER_BITS = 1 << 24


def split_by_keys(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that may have their doc_id among ids, and rows that have not (those without one, too), by a
    bit filter of a fixed size: what the filter settles needs no shuffle of the texts."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    cells = written(
        ids.select(place("doc_id").alias("_p")).groupBy(F.shiftright("_p", 6).alias("_cell")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits")
        ),
        "filter",
    )
    # the row as one column, so that no column of it can clash
    rows = docs.select(F.struct("*").alias("_row"), place("doc_id").alias("_p"))
    seen = rows.withColumn("_cell", F.shiftright("_p", 6)).join(F.broadcast(cells), "_cell", "left")
    hit = "coalesce(_row.doc_id is not null and (_bits & shiftleft(1L, cast(_p % 64 as int))) <> 0, false)"
    return seen.where(hit).select("_row.*"), seen.where(f"not {hit}").select("_row.*")


def only_keys(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids: most others fall to the filter before the join."""
    return split_by_keys(docs, ids)[0].join(ids, "doc_id", "left_semi")


def without_keys(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids."""
    ids = written(ids, "keys")
    near, far = split_by_keys(docs, ids)
    return near.join(ids, "doc_id", "left_anti").select(docs.columns).union(far)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null, empty or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES + "+"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b) of long ids.

    Returns (node, root) for every node of an edge between two different nodes, root the smallest id that it
    reaches. Alternates large-star and small-star steps until nothing changes; each step is a grouped minimum
    with map-side combine and a join on the node, so that a component is never gathered in one task, and is
    written to the shared folder. Null ids and loops are ignored; no rows give no rows.
    """
    links = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    for _ in range(most_rounds):
        # done when every node has one parent at most, and no parent has one
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            links.select("v", F.lit(0), F.lit(1))
        )
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).where("ups + down > 1").isEmpty():
            break
        # large star: every greater neighbour of u goes to the least of u and its neighbours
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours go to the least of these
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        back = (
            large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
        )
        after = written(back.distinct(), "edges")
        release(links)
        links = after
    else:
        raise RuntimeError("components have not converged")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
