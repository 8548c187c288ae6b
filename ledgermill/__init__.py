"""Ledgermill: import, search, extraction, scoring and merging of business records on Spark DataFrames."""
