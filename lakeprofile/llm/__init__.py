"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and names of the columns it reads, ignores any other column, and
returns a DataFrame keyed by the identifier column it was given.
"""
