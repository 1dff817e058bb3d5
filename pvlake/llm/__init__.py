"""Training-data pipeline operators: quality, deduplication, toxicity, tokens, packing, personal data.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
