"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["catalog_queries", "style_queries", "match_queries", "upkeep_queries"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"asset_atlas.driver.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
