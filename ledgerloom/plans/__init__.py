"""Assembled jobs and the registered queries."""
