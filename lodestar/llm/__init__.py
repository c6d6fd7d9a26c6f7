"""Operators for preparing large training corpora, each on plain DataFrames.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
