"""Substring search and text-index analytics over DataFrames."""
