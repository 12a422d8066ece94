"""Corpus operators for training-data pipelines, each a function over DataFrames."""
