"""Whole scans."""
