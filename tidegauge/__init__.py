"""Sensor-table analytics on Spark: sources, casts, summaries, windows, quality checks."""
