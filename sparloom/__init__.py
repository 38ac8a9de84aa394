"""Trajectory curation and corpus preparation on Spark DataFrames."""
