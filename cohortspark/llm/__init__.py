"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and the names of the columns it works on, and returns a DataFrame;
columns it does not name are never read, so extra columns cannot clash.
"""
