"""Ledgermill functions."""
