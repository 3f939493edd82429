"""Pipeline operators: DataFrames in, DataFrames out."""
