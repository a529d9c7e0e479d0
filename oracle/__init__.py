"""DuckDB oracle SQL and the Spark-vs-DuckDB comparison used by tests."""
