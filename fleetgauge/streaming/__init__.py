"""Continuous ingestion of landed logs."""
