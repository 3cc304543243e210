"""Relational building blocks: as-of joins, windows, ranks, ledgers."""
