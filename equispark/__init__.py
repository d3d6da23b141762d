"""Equity analytics on Spark: typed tables, derived metrics, screens, logs and streams."""
