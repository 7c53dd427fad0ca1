"""Lineage, row provenance, dependency graphs and run logs."""
