"""Operators on registers: DataFrame in, DataFrame out."""
