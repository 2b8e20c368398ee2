"""Training-data operators.

Every operator is a function from DataFrames to DataFrames in a module of its own; ``queries`` holds
the thin registered queries and their SQL. Nothing outside this subpackage imports it.
"""
