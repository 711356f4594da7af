"""Importing this module fills the registry."""

from creaseline.queries import core, files, fixtures, ingest, logs, models, names, scalars, tables  # noqa: F401
from creaseline.queries.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
