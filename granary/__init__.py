"""Granary: behavioural-evidence analytics on Spark DataFrames."""
