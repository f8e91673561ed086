"""All registered queries."""

from cloudloom.catalog import clouds, scores, shapes, storage  # noqa: F401
from cloudloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
