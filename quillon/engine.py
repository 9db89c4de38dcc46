"""The front door: SQL and operators over a catalog."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .plans.report import explain_text
from .sources.catalog import Catalog

_views = threading.RLock()


class Engine:
    """Answers SQL over the tables of a catalog."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.spark = catalog.spark

    def sql(self, query: str) -> DataFrame:
        """The result, not run yet. Names are resolved now, so that a wrong one is an error here, and against this
        engine's tables only: views of the session with these names stand aside meanwhile. Only tables that the
        query's text names are looked up, so that no other footer is read."""
        names = sorted(set(re.findall(r"\w+", query.lower())).intersection(self.catalog.names))
        known = self.spark._jsparkSession.sessionState().catalog()
        with _views:
            aside = {name: self.spark.table(name) for name in names if known.getTempView(name).isDefined()}
            try:
                for name in names:
                    self.catalog.table(name).createOrReplaceTempView(name)
                return self.spark.sql(query)
            finally:
                for name in names:
                    if name in aside:
                        aside[name].createOrReplaceTempView(name)
                    else:
                        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def explain(self, query: str) -> str:
        return explain_text(self.sql(query), "extended")

    def batches(self, query: str | DataFrame, size: int = 100_000) -> Iterator[pa.RecordBatch]:
        """The result as record batches of ``size`` rows, the last with what is left. Columns stay columns: tasks
        hand over Arrow streams, and the driver holds those of one partition and less than a batch more."""
        rows = self.sql(query) if isinstance(query, str) else query

        def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["stream"])

        pending: list[pa.Table] = []
        held = 0
        for row in rows.mapInArrow(streams, "stream binary").toLocalIterator():
            pending.append(pa.ipc.open_stream(bytes(row["stream"])).read_all())
            held += pending[-1].num_rows
            if held >= size:
                whole = pa.concat_tables(pending)
                full = held - held % size
                for begin in range(0, full, size):
                    yield whole.slice(begin, size).combine_chunks().to_batches()[0]
                pending, held = [whole.slice(full)], held - full
        if held:
            yield pa.concat_tables(pending).combine_chunks().to_batches()[0]
