"""Signals, series and texts as compact signatures: fingerprinting, search and data preparation on Spark."""
