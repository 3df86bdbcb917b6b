"""Registered queries, grouped by task."""

from proseforge.plans import corpus, distributions, examples, production, scoring  # noqa: F401
from proseforge.plans.registry import QUERIES, SQL  # noqa: F401
