"""Annotated sparse matrices (cells x genes) as Spark DataFrames."""
