"""Stores on any Hadoop file system: sorted Parquet runs under an append-only manifest."""
