"""Ledgermill operators."""
