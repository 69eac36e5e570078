"""Corpus analytics on Spark: ingest, training snapshots, retrieval and evaluation tables.

Every operator is a function from DataFrames and parameters to a DataFrame.
"""
