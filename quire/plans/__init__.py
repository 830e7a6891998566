"""Registered queries: each operator over a projection of the driver's tables, with its DuckDB equivalent where SQL can say it."""
