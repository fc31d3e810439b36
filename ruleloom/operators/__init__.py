"""Aggregates over lists: inside a row, or lifted onto a child table."""
