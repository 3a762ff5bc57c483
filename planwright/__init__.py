"""Planwright: floor-plan analytics as ordinary Spark DataFrames."""

__version__ = "0.1.0"
