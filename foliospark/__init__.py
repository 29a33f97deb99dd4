"""Declarative extraction and search over large document collections, on Spark DataFrames."""
