"""SQL that derives the same tables and the same results, for DuckDB."""
