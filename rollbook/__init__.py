"""Rollbook: cleaning, profiling and indicator reports for client registers, on Spark.

Every function takes and returns lazy DataFrames or Columns. No function starts a session.
"""
