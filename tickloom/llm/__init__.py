"""Training-data operators: deduplication, search, filtering, formatting and mixing of text corpora.

Nothing else in the library imports this subpackage.
"""
