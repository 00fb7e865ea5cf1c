"""Terrain, road-network, place and device-position analytics on Spark DataFrames."""

__version__ = "0.1.0"
