"""Readers, cleaning and feed rules."""
