"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from prismet.plans import algorithm_queries, glue_queries, measure_queries, ontology_queries, vector_queries  # noqa: F401
from prismet.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
