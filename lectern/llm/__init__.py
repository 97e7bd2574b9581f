"""Training-data operators.  Nothing outside this subpackage imports it.

Each operator takes DataFrames and returns a DataFrame; the queries that apply
them to whole tables, and the SQL they are held against, are in ``queries``.
"""
