"""Every registered query of the cell analytics operators, and its SQL."""

from __future__ import annotations

from .plans import curation, features, files, gates, graphs, images, models, neighbours, predicted, spatial, stored  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
