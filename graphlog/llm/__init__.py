"""Training-data operators: search, tokenising, quality, near duplicates, packing and more.

Nothing else in the library imports this subpackage; ``queries`` holds the registered queries.
"""
