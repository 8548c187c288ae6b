"""Ledgermill sources."""
