"""Registered queries, their DuckDB twins and the table bindings."""
