"""Training-data operators: WARC assembly, near-duplicates, packing, search, language and quality models.

Nothing else in the library imports this subpackage; ``queries`` here is what the entry module adds.
"""
