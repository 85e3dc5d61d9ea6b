"""The checks: each function takes DataFrames and returns a DataFrame or a column."""
