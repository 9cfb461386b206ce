"""Turning Python source text into syntax facts, with the standard library alone."""
