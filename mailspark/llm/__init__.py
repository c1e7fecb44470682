"""Training-data operators: deduplication, extraction, tokenisation and scoring of text corpora.

Nothing else in the library imports this subpackage.
"""
