"""Tallyscope: profile, filter and page through large tables with Spark."""

from tallyscope.functions.display import percent_text, preview
from tallyscope.operators.cube import Cube
from tallyscope.operators.selection import Between, IsNull, OccursOnce, Selection, ValueIs
from tallyscope.plans.session import Session

__all__ = [
    "Between", "Cube", "IsNull", "OccursOnce", "Selection", "Session", "ValueIs",
    "percent_text", "preview",
]
