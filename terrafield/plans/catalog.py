"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("spatial_queries", "path_queries", "terrain_queries", "place_queries", "rule_queries", "geodesy_queries", "quality_queries", "graph_queries", "stream_queries")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
