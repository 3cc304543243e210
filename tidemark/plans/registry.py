"""Collects the queries of every plan module."""

from __future__ import annotations

from importlib import import_module

#: Plan modules; each has QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES: list[str] = ["feature_plane", "pit_plane", "portfolio_plane", "store_plane", "relational_plane", "records_plane", "sql_plane", "build_plane"]


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tidemark.plans.{name}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")


def flagship(spark, sf_dir):
    return queries()["t02_momentum_top10"](spark, sf_dir)
