"""Bounded-memory summaries of event streams as Spark queries."""
