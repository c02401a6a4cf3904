"""Cohort time-series analytics on Spark DataFrames."""
