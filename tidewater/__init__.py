"""Tidewater: a PySpark-native engine for quantitative time-series research."""

__version__ = "0.1.0"
