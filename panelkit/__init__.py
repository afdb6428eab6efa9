"""Spark operators for large panels of event counts (place x day x event type)."""
