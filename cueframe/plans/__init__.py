"""Chains of named steps over DataFrames."""
