"""Query plans over the provided tables: each registered query has a Spark
implementation and (where SQL can express it) a DuckDB oracle string."""
