"""Ledgermill streaming."""
