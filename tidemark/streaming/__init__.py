"""Structured Streaming counterparts of the batch operators; both call the same step functions."""
