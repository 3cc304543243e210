"""Registered queries, grouped by plane, each with its DuckDB counterpart."""
