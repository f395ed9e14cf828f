"""Profiling operators: DataFrame in, DataFrame out."""
