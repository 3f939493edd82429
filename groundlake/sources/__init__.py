"""Scans and fetchers."""
