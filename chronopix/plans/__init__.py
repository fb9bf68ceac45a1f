"""Registered queries."""

from __future__ import annotations

from . import files, modelling, numerics, relational  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
