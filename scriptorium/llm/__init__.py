"""Training-data operators: cleaning, deduplication, privacy, mixing, tokenisation.

Nothing outside this subpackage imports it.
"""
