"""Column expressions: calendar, encoding, quantiles and test statistics."""
