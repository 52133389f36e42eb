"""Training-data operators: tokenising, cleaning, deduplication, search and archives.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
