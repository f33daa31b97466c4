"""Incremental ingestion of statements (an extra: the batch operators do not need it)."""
