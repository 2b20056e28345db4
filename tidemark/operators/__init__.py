"""Summaries: running statistics, time rings, matrices, matrix profile, sketches, quantiles, heavy hitters."""
