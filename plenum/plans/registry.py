"""All queries over the driver tables by name, and the SQL each is checked against."""

from plenum.plans import audits, changes, clusters, feeds, joins, journeys, layouts, minutes, names, rollups, scans, shapes, streams, texts, windows  # noqa: F401
from plenum.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
