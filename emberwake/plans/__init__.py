"""All queries of the library by name, with oracles."""

from . import clusters, eda, models  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
