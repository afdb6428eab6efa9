"""Runnable plans over the driver's tables: stand-in inputs, queries, oracle SQL."""
