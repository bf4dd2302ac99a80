"""Personal-health time-series analytics as Spark DataFrame functions."""
