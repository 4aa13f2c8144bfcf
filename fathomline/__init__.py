"""Time-series, event and document analytics as plain Spark plans."""
