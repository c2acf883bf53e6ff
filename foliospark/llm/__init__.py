"""Training-data operators: quality, deduplication, mixing, tokenisation and related scoring.

Nothing outside this subpackage imports it.
"""
