"""Thin streaming wrappers around batch operators."""
