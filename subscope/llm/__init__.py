"""Training-data operators: search, scans, filters, deduplication, token counts and packing.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns a
DataFrame; `queries.py` holds the registered queries over the given tables.
"""
