"""Forecast benchmarks, condition mining and data profiles over time-ordered
tables, written as plain Spark DataFrame operators."""
