"""Operators for building text training data on Spark.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` binds them to the synthetic tables.
"""
