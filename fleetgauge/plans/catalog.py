"""Importing this module registers every query."""

from fleetgauge.plans import diagnosis_queries, document_queries, ingest_queries, report_queries, telemetry_queries, verification_queries  # noqa: F401
from fleetgauge.plans.registry import ORACLE, QUERIES  # noqa: F401
