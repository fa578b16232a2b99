"""Ledgerloom: set-wise financial reconciliation on Spark DataFrames."""
