"""Registered queries: each operator over the given tables, with equivalent SQL."""

import importlib

from pricemill.registry.entries import ORACLES, QUERIES

for _name in ("market", "rates", "series", "tables", "serve", "parsing", "checks", "streams"):
    importlib.import_module(f"pricemill.registry.{_name}")

__all__ = ["ORACLES", "QUERIES"]
