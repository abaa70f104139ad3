"""Scans, parsers and derived views over tables."""
