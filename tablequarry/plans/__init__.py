"""Named queries over a lake of parquet tables, and their SQL."""

from . import files, lookups, queries, semantics  # noqa: F401  each registers its queries
