"""Named end-to-end queries (Spark) and their DuckDB oracle SQL."""
