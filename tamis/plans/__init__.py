"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from tamis.plans import curation, filters, judges, predictions, relational, releases, texts
from tamis.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curation", "filters", "judges", "predictions", "relational", "releases", "texts"]
