"""All registered queries."""

from attesta.plans import documents, measures, provenance, relations, texts  # noqa: F401
from attesta.plans.registry import CATALOG, ORACLES

__all__ = ["CATALOG", "ORACLES"]
