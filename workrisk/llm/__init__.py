"""Training-data operators: tokenisation, quality, toxicity, dedup, mixing, sharding.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries.
"""
