"""Training-data operators: extraction, filters, dedup, tokenising, formatting and packing.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and column
names, selects only the columns it needs (so extra or clashing columns are harmless) and returns a
DataFrame with its own fixed columns.
"""
