"""Every runnable query by name, wired to the test tables."""

from orderlens.catalog import health, intake, live, review, risk, stock  # noqa: F401
from orderlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
