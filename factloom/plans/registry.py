"""All registered queries and their SQL oracles, collected from the families' modules."""

from __future__ import annotations

from factloom.plans import builds, cases, composites, documents, evaluations, lookups, records, relations, runs, texts  # noqa: F401
from factloom.plans.base import ORACLES, QUERIES  # noqa: F401
