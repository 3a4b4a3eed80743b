"""Training-data operators: scans, joins, models and writers over text tables.

Nothing outside this package imports it.  Every operator takes DataFrames and
column names and returns a DataFrame; ``queries`` binds them to the tables.
"""
