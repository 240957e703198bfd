"""Corpus-scale text reduction and retention on Spark.

Captured outputs and plain texts become rows of a line table; every operator takes and returns
DataFrames, so one call works on one text or on a whole corpus.
"""
