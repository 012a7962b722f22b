"""All queries and their SQL: importing the modules registers them."""

from . import signed, trial  # noqa: F401
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
