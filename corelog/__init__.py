"""Ordered, grouped and located measurement analytics on PySpark DataFrames."""
