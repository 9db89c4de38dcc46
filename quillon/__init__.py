"""A Spark-first analytics engine over Parquet tables: a catalog, SQL, scans, summaries, joins and reports."""

from .engine import Engine
from .session import session
from .sources.catalog import Catalog

__all__ = ["Catalog", "Engine", "session"]
