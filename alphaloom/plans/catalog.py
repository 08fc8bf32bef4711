"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import q_altdata, q_app, q_fundamentals, q_sources, q_text  # noqa: F401
from .registry import REGISTRY


def all_queries():
    return REGISTRY
