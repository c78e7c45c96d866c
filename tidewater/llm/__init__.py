"""Operators for preparing training data: each is a Spark job over whole tables."""
