"""Operators of a training-data pipeline over document, page and label tables.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames plus the names of the columns it needs, ignores all other columns
(so extra columns with clashing names never matter) and returns a DataFrame.
"""
