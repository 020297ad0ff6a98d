"""Landed registries and pages."""

from . import registries  # noqa: F401 - registers the five registries
from .spec import REGISTRY, SourceSpec, build, first_per_id, page_scan, register

__all__ = ["REGISTRY", "SourceSpec", "build", "first_per_id", "page_scan", "register"]
