"""Scalar building blocks: time buckets, saturation, hashing, binary codecs."""
