"""Query plans: pipeline stages, the query registry and the DuckDB oracles."""
