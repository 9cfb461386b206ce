"""Scans of source files as they arrive."""
