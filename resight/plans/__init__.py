"""Registered queries, and the SQL that they are held against."""

from __future__ import annotations

from . import documents, market, scalar, state  # noqa: F401  they fill the registry
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
