"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

FLAGSHIP = "logic_ship_parcel"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
