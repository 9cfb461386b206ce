"""Inputs: source trees, ignore files, the registry, configuration, baselines."""
