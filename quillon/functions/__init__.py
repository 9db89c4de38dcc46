"""Reports on keys and partitions."""
