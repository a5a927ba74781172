"""Registered queries: operators bound to the landed tables, each with its SQL twin."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ["features_q", "scalars_q", "board_q", "joins_q", "sizing_q", "records_q", "market_q", "feeds_q",
           "streams_q", "models_q", "published_q"]


def load():
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
