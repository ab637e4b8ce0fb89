"""Joins, windows and aggregations over keyed series."""
