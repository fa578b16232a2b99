"""Incremental jobs over the batch operators."""
