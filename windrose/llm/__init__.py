"""Training-data operators: tokenisation, filtering, deduplication, scoring.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame over named id and text columns; it reads just those
two, so further columns, whatever their names, can't clash with its results.
"""
