"""Training-data operators: packing, quality, dedup, chat format, fingerprints, WARC, mixing, sharding.

Every operator takes DataFrames and column names and returns a DataFrame. `queries.py` holds the thin
contract queries over the driver's tables.
"""
