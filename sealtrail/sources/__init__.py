"""Stored ledgers and file readers."""
