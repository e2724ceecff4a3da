"""Imports every module that registers queries."""

import quillspark.plans.style  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
