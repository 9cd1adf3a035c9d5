"""The registered queries and their SQL forms."""

from . import find, relational, reviews, scans, search, series, stores, texts, views, waves  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
