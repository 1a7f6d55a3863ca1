"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from glyphloom.plans import confidence, layout, more, pipeline, reports, rules, scoring, slides, translation  # noqa: F401
from glyphloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
