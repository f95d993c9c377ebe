"""Readers of published files and ledgers."""
