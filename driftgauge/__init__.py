"""Spark-native compatibility forecasting for bodies of Python source code."""
