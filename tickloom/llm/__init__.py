"""Training-data operators: packing, dedup, scoring, mixing, archives, token counts and quality rules.

Every operator takes and returns DataFrames; nothing outside this package imports it.
"""
