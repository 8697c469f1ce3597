"""tamis: a PySpark library for curating reasoning training data.

Every operator takes and returns DataFrames; nothing here collects rows to the driver unless
their number is bounded by the number of strata, checkpoints or clusters.
"""
