"""Tables: the catalog, Parquet scans and layouts, generated data."""
