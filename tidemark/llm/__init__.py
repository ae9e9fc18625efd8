"""Training-data operators: scoring, cleaning, deduplication, mixing and archives of text corpora.

Nothing else in the library imports this subpackage.
"""
