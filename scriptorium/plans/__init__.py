"""Registered queries: each is a Spark plan with an equivalent SQL text beside it."""
