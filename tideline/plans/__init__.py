"""Importing this package registers every query of the catalog."""

from tideline.plans.catalog import CATALOG
from tideline.plans import evaluation, events, joins, landing, learning, records, screening, signals, streams, tables, windows  # noqa: F401

__all__ = ["CATALOG"]
