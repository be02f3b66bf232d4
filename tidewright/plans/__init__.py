"""Queries bound to the given tables; importing the package fills the registry."""

from .base import REGISTRY, Query, Tables

from . import matching, skill_reports, anomalies, onsets, spatial, depths, forcings, nutrients, surveys, calendars, stores  # noqa: F401, E402  isort: skip

__all__ = ["REGISTRY", "Query", "Tables"]
