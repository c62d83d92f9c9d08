"""Queries over the driver's tables, one for each operator, with the SQL that they are held against."""

from galena.plans import aggregates, classification, collection, commerce, identity, joins, pages, resolution, scalars, streams, windows  # noqa: F401
from galena.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
