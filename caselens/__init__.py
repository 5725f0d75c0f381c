"""Spark jobs that turn incident telemetry into audited training tables."""
