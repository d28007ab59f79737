"""DuckDB reference SQL for the registered queries, written independently of the Spark code."""
